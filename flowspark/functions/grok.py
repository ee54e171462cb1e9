"""Named log patterns: `%{NAME:field}` templates compiled to one Java regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The pattern library, one `NAME regex` per line.
LIBRARY_TEXT = r"""
USERNAME [a-zA-Z0-9._-]+
USER %{USERNAME}
EMAILLOCALPART [a-zA-Z][a-zA-Z0-9_.+-=:]+
EMAILADDRESS %{EMAILLOCALPART}@%{HOSTNAME}
HTTPDUSER %{EMAILADDRESS}|%{USER}
INT (?:[+-]?(?:[0-9]+))
BASE10NUM (?<![0-9.+-])(?>[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|(?:\.[0-9]+)))
NUMBER (?:%{BASE10NUM})
BASE16NUM (?<![0-9A-Fa-f])(?:[+-]?(?:0x)?(?:[0-9A-Fa-f]+))
BASE16FLOAT \b(?<![0-9A-Fa-f.])(?:[+-]?(?:0x)?(?:(?:[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?)|(?:\.[0-9A-Fa-f]+)))\b
POSINT \b(?:[1-9][0-9]*)\b
NONNEGINT \b(?:[0-9]+)\b
WORD \b\w+\b
NOTSPACE \S+
SPACE \s*
DATA .*?
GREEDYDATA .*
ALL [\s|\S]*
ALLS [\s|\S]*?
GDATA .*
QUOTEDSTRING (?>(?<!\\)(?>"(?>\\.|[^\\"]+)+"|""|(?>'(?>\\.|[^\\']+)+')|''|(?>`(?>\\.|[^\\`]+)+`)|``))
UUID [A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}
MAC (?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})
CISCOMAC (?:(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4})
WINDOWSMAC (?:(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2})
COMMONMAC (?:(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2})
IPV6 ((([0-9A-Fa-f]{1,4}:){7}([0-9A-Fa-f]{1,4}|:))|(([0-9A-Fa-f]{1,4}:){6}(:[0-9A-Fa-f]{1,4}|((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})|:))|(([0-9A-Fa-f]{1,4}:){5}(((:[0-9A-Fa-f]{1,4}){1,2})|:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})|:))|(([0-9A-Fa-f]{1,4}:){4}(((:[0-9A-Fa-f]{1,4}){1,3})|((:[0-9A-Fa-f]{1,4})?:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}))|:))|(([0-9A-Fa-f]{1,4}:){3}(((:[0-9A-Fa-f]{1,4}){1,4})|((:[0-9A-Fa-f]{1,4}){0,2}:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}))|:))|(([0-9A-Fa-f]{1,4}:){2}(((:[0-9A-Fa-f]{1,4}){1,5})|((:[0-9A-Fa-f]{1,4}){0,3}:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}))|:))|(([0-9A-Fa-f]{1,4}:){1}(((:[0-9A-Fa-f]{1,4}){1,6})|((:[0-9A-Fa-f]{1,4}){0,4}:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}))|:))|(:(((:[0-9A-Fa-f]{1,4}){1,7})|((:[0-9A-Fa-f]{1,4}){0,5}:((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}))|:)))(%.+)?
IPV4 (?<![0-9])(?:(?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5]))(?![0-9])
IP (?:%{IPV6}|%{IPV4})
HOSTNAME \b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(\.?|\b)
HOST %{HOSTNAME}
IPORHOST (?:%{HOSTNAME}|%{IP})
HOSTPORT (?:%{IPORHOST}:%{POSINT:PORT})
PATH (?:%{UNIXPATH}|%{WINPATH})
UNIXPATH (/([\w_%!$@:.,~-]+|\\.)*)+
TTY (?:/dev/(pts|tty([pq])?)(\w+)?/?(?:[0-9]+))
WINPATH (?>[A-Za-z]+:|\\)(?:\\[^\\?*]*)+
URIPROTO [A-Za-z]+(\+[A-Za-z+]+)?
URIHOST %{IPORHOST}(?::%{POSINT:port})?
URIPATH (?:/[A-Za-z0-9$.+!*'(){},~:;=@#%_\-]*)+
URIPARAM \?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*
URIPATHPARAM %{URIPATH}(?:%{URIPARAM})?
URI %{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?
MONTH \b(?:Jan(?:uary|uar)?|Feb(?:ruary|ruar)?|M(?:a|ä)?r(?:ch|z)?|Apr(?:il)?|Ma(?:y|i)?|Jun(?:e|i)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|O(?:c|k)?t(?:ober)?|Nov(?:ember)?|De(?:c|z)(?:ember)?)\b
MONTH_NUM (?:0?[1-9]|1[0-2])
MONTH_NUM2 (?:0[1-9]|1[0-2])
MONTH_DAY (?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])
DAY (?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)
DAY_ZH_CN \u661f\u671f(\u4e00|\u4e8c|\u4e09|\u56db|\u4e94|\u516d|\u4e03)
YEAR (?>\d\d){1,2}
HOUR (?:2[0123]|[01]?[0-9])
MINUTE (?:[0-5][0-9])
SECOND (?:(?:[0-5]?[0-9]|60)(?:[:.,]%{MCRO_SECOND})?)
MCRO_SECOND [0-9]+
TIME (?!<[0-9])%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])?
DATE_US %{MONTH_NUM}[./-]?%{MONTH_DAY}[./-]?%{YEAR}
DATE_EU %{MONTH_NUM}[./-]?%{MONTH_NUM}[./-]?%{YEAR}
DATE_ISO8601 %{YEAR}[./-]?%{MONTH_NUM}[./-]?%{MONTH_DAY}
DATE_ZH_CN %{YEAR}\u5e74%{MONTH_NUM}\u6708%{MONTH_DAY}\u65e5
TIME_ZH_CN %{HOUR}\u65f6%{MINUTE}(?:\u5206%{SECOND})\u79d2
TIMESTAMP %{DATE_ZH_CN}[ ]%{DAY_ZH_CN}[ ]%{TIME_ZH_CN}
ISO8601_TIMEZONE (?:Z|[+-]%{HOUR}(?::?%{MINUTE}))
ISO8601_SECOND (?:%{SECOND}|60)
TIMESTAMP_ISO8601 %{DATE_ISO8601}[T ]?%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?
DATE_CM %{MONTH}[ ./-]?%{MONTH_DAY}[ ./-]?%{YEAR}
DATE %{DATE_US}|%{DATE_EU}|%{DATE_ISO8601}|%{DATE_CM}
TZ (?:[PMCE][SD]T|UTC|CST)
DATESTAMP_ISO8601 %{DATE_ISO8601}[-T ]?%{TIME}%{ISO8601_TIMEZONE}?[-T ]?%{TZ}?
DATESTAMP_RFC822 %{DAY} %{MONTH} %{MONTH_DAY} %{YEAR} %{TIME} %{TZ}
DATESTAMP_RFC2822 %{DAY}, %{MONTH_DAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}
DATESTAMP_OTHER %{DAY} %{MONTH} %{MONTH_DAY} %{TIME} %{TZ} %{YEAR}
DATESTAMP_EVENTLOG %{YEAR}%{MONTH_NUM2}%{MONTH_DAY}%{HOUR}%{MINUTE}%{SECOND}
DATESTAMP (%{DATE}[-T ]?%{TIME}%{ISO8601_TIMEZONE}?)|(%{DATESTAMP_ISO8601})|(%{TIMESTAMP})|(%{TIMESTAMP_ISO8601})|(%{SYSLOGTIMESTAMP})|(%{DATESTAMP_OTHER})
SYSLOGTIMESTAMP %{MONTH} +%{MONTH_DAY} %{TIME}( %{YEAR})?
PROG (?:[\w._/%-]+)
SYSLOGPROG %{PROG:program}(?:\[%{POSINT:pid}\])?
SYSLOGHOST %{IPORHOST}
SYSLOGFACILITY <%{NONNEGINT:facility}.%{NONNEGINT:priority}>
HTTPDATE %{MONTH_DAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}
QS %{QUOTEDSTRING}
SYSLOGBASE %{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:
MESSAGESLOG %{SYSLOGBASE} %{DATA}
COMMONAPACHELOG %{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:@timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)
COMBINEDAPACHELOG %{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}
LOGLEVEL ([A|a]lert|ALERT|[T|t]race|TRACE|[D|d]ebug|DEBUG|[N|n]otice|NOTICE|[I|i]nfo|INFO|[W|w]arn?(?:ing)?|WARN?(?:ING)?|[E|e]rr?(?:or)?|ERR?(?:OR)?|[C|c]rit?(?:ical)?|CRIT?(?:ICAL)?|[F|f]atal|FATAL|[S|s]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)
"""

LIBRARY = dict(line.split(" ", 1) for line in LIBRARY_TEXT.strip().splitlines() if line.strip())

#: Patterns of one part of a date or time. `_HOUR` and the like capture theirs as `_hour`; with `time_parts` all do.
TIME_PARTS = ("YEAR", "MONTH", "MONTH_NUM", "MONTH_NUM2", "MONTH_DAY", "DAY", "DAY_ZH_CN", "HOUR", "MINUTE", "SECOND", "MCRO_SECOND")
CAPTURED = {f"_{name}": f"%{{{name}:_{name.lower()}}}" for name in TIME_PARTS}

_REFERENCE = re.compile(r"%\{(\w+)(?::([^}:]+))?(?::[^}]*)?\}")


@dataclass(frozen=True)
class Grok:
    """A compiled template: the regex, per field name its first group number, and all of them where alternatives share it."""

    regex: str
    groups: dict[str, int]
    every: dict[str, tuple[int, ...]]


def expand(template: str, library: dict[str, str] | None = None, time_parts: bool = False) -> Grok:
    """Replace pattern references until none is left and number the capturing groups.

    `time_parts`: parts of dates and times inside larger patterns (`TIME`, `DATESTAMP`) are captured too."""
    known = {**LIBRARY, **CAPTURED, **(library or {})}
    names: list[str] = []

    def mark(match, depth=0):
        name, field = match.group(1), match.group(2)
        if name not in known:
            raise ValueError(f"unknown pattern {name}")
        if depth > 30:
            raise ValueError(f"pattern {name} refers to itself")
        body = _REFERENCE.sub(lambda m: mark(m, depth + 1), known[name])
        if field is None and time_parts and name in TIME_PARTS:
            field = f"_{name.lower()}"
        if field is None:
            return f"(?:{body})"
        names.append(field)
        return f"(?<f{len(names) - 1}f>{body})"

    regex = _REFERENCE.sub(mark, template)
    numbers = group_numbers(regex)
    every: dict[str, tuple[int, ...]] = {}
    for at, field in enumerate(names):
        every[field] = (*every.get(field, ()), numbers[f"f{at}f"])
    for name, number in numbers.items():
        if not re.fullmatch(r"f\d+f", name):
            every[name] = (*every.get(name, ()), number)
    return Grok(regex, {name: found[0] for name, found in every.items()}, every)


def group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of the named groups `(?<name>...)`."""
    number, names, at, inside = 0, {}, 0, False
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 2
            continue
        if sign == "[":
            inside = True
        elif sign == "]":
            inside = False
        elif sign == "(" and not inside:
            named = re.match(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern[at:])
            if named:
                number += 1
                names[named.group(1)] = number
            elif not pattern.startswith("(?", at):
                number += 1
        at += 1
    return names
