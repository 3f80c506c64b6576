"""Grok expressions -> Java regular expressions with capture positions.

Spark evaluates ``java.util.regex`` but hands captures out by *number*, so the
expansion (which happens once, on the driver) also works out which group number
each field has, and whether that group may stay unset in a successful match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Commonly published grok names and their expressions.
COMMON_GROK = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "BASE10NUM": r"(?<![0-9.+-])(?>[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|(?:\.[0-9]+)))",
    "NUMBER": r"(?:%{BASE10NUM})",
    "BASE16NUM": r"(?<![0-9A-Fa-f])(?:[+-]?(?:0x)?(?:[0-9A-Fa-f]+))",
    "BASE16FLOAT": r"\b(?<![0-9A-Fa-f.])(?:[+-]?(?:0x)?(?:(?:[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?)|(?:\.[0-9A-Fa-f]+)))\b",
    "POSINT": r"\b(?:[1-9][0-9]*)\b",
    "NONNEGINT": r"\b(?:[0-9]+)\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"""(?>(?<!\\)(?>"(?>\\.|[^\\"]+)+"|""|(?>'(?>\\.|[^\\']+)+')|''|(?>`(?>\\.|[^\\`]+)+`)|``))""",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "URN": r"urn:[0-9A-Za-z][0-9A-Za-z-]{0,31}:(?:%[0-9a-fA-F]{2}|[0-9A-Za-z()+,.:=@;$_!*'/?#-])+",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,64}(?:\.[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,62}){0,63}",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "CISCOMAC": r"(?:(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4})",
    "WINDOWSMAC": r"(?:(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2})",
    "COMMONMAC": r"(?:(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2})",
    "MAC": r"(?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})",
    "IPV6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|:(?:(?::[0-9A-Fa-f]{1,4}){1,7}|:))",
    "IPV4": r"(?<![0-9])(?:(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})[.](?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})[.](?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})[.](?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2}))(?![0-9])",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(?:\.?|\b)",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"(?:%{HOSTNAME}|%{IP})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"(?>/(?>[\w_%!$@:.,~-]+|\\.)*)+",
    "TTY": r"(?:/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+))",
    "WINPATH": r"(?>[A-Za-z]+:|\\)(?:\\[^\\?*]*)+",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "URIPROTO": r"[A-Za-z]+(?:\+[A-Za-z+]+)?",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHNUM2": r"(?:0[1-9]|1[0-2])",
    "MONTHDAY": r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?>\d\d){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5][0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"(?!<[0-9])%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "DATE": r"(?:%{DATE_US}|%{DATE_EU})",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))",
    "ISO8601_SECOND": r"(?:%{SECOND}|60)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "TZ": r"(?:[PMCE][SD]T|UTC)",
    "DATESTAMP": r"%{DATE}[- ]%{TIME}",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}",
    "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}",
    "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    "HTTPDERROR_DATE": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{YEAR}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"(?:[\w._/%-]+)",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}\.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "MESSAGESLOG": r"%{SYSLOGBASE} %{DATA}",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": r"(?:[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn?(?:ing)?|WARN?(?:ING)?|[Ee]rr?(?:or)?|ERR?(?:OR)?|[Cc]rit?(?:ical)?|CRIT?(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
    "COMMONAPACHELOG": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)',
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
}

# The extra names every pattern set may use; the JSON, CSV and
# URLARGS families also mark how the captured text is parsed further.
EXTRA_GROK = {
    "LD": r".*",
    "JSON": r".*",
    "JSON_NESTED": r".*",
    "CSV": r".*",
    "CSV_NESTED": r".*",
    "NOTCOMMA": r"[^,]*?",
    "URLARGS": r"%{NOTSPACE}",
    "URLARGS_NESTED": r"%{NOTSPACE}",
    "IPNULL": r"(?:%{IP}|.*)",
    "IPNULLNOTCOMMA": r"(?:%{IP}|[^,]*)",
    "HOSTNULL": r"(?:%{HOST}|.*)",
    "HOSTNULLNOTCOMMA": r"(?:%{HOST}|[^,]*)",
    "ESCAPEDQS": r"""([\\]?(?:(?>"(?>\\.|[^"]+)+"|""|(?>'(?>\\.|[^']+)+')|''|(?>`(?>\\.|[^`]+)+`)|``))|[^,]*)""",
    "ESCAPEDQSORNOTCOMMA": r"(?:%{ESCAPEDQS}|%{NOTCOMMA})",
    "WINEVT": r"%{INT}\t%{JSON:data}",
}

# Grok names that give the captured field a type.
GROK_TYPES = {
    "INT": "int",
    "CSV": "csv",
    "CSV_NESTED": "csv.nested",
    "JSON": "json",
    "JSON_NESTED": "json.nested",
    "URLARGS": "urlargs",
    "URLARGS_NESTED": "urlargs.nested",
}

_REFERENCE = re.compile(r"%\{(\w+)(?::([^{}:]+))?\}")
_JAVA_GROUP = re.compile(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>")
_MARK = "fieldmark"
_MAX_DEPTH = 30


class GrokError(ValueError):
    """The expression names an unknown grok pattern or is recursive."""


@dataclass(frozen=True)
class Capture:
    """One named field of an expression: its group number in the final regex."""

    name: str
    group: int
    optional: bool


@dataclass(frozen=True)
class Grok:
    """A compiled expression. ``regex`` matches the whole line."""

    source: str
    regex: str
    captures: tuple[Capture, ...]
    types: dict[str, str] = field(hash=False, compare=False, default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(c.name for c in self.captures))


def compile_grok(expression: str, custom: dict[str, str] | None = None) -> Grok:
    """Expand ``%{NAME:field}`` references (also nested ones) into one regex."""
    library = {**COMMON_GROK, **EXTRA_GROK, **(custom or {})}
    fields: list[str] = []

    def expand(text: str, depth: int) -> str:
        if depth > _MAX_DEPTH:
            raise GrokError(f"grok definitions nest too deeply in {expression!r}")

        def one(m: re.Match) -> str:
            name, subname = m.group(1), m.group(2)
            if name not in library:
                raise GrokError(f"no grok definition named {name!r}")
            inner = expand(library[name], depth + 1)
            if subname is None:
                return f"(?:{inner})"
            fields.append(subname.strip())
            return f"(?<{_MARK}{len(fields) - 1}>{inner})"

        return _REFERENCE.sub(one, text)

    # Nested fields are numbered in the order in which their outer reference is met.
    expanded = expand(expression, 0)
    captures = tuple(
        Capture(fields[int(n[len(_MARK):])] if n.startswith(_MARK) else n, g, o)
        for n, g, o in _named_groups(expanded)
    )
    types: dict[str, str] = {}
    for name, subname in _REFERENCE.findall(expression):
        if subname and name.upper() in GROK_TYPES:
            types[subname.strip()] = GROK_TYPES[name.upper()]
    fields_typed = {c.name: types.get(c.name, "string") for c in captures}
    return Grok(expression, rf"\A(?:{expanded})\z", captures, fields_typed)


def _named_groups(regex: str) -> list[tuple[str, int, bool]]:
    """(name, group number, may stay unset) of every named group, left to right."""
    groups: list[dict] = []
    root = {"number": 0, "name": None, "alternation": False, "parent": None, "loose": False}
    current, number, i, n = root, 0, 0, len(regex)
    while i < n:
        ch = regex[i]
        if ch == "\\":
            if regex[i + 1:i + 2] == "Q":
                end = regex.find(r"\E", i)
                i = n if end < 0 else end + 2
            else:
                i += 2
            continue
        if ch == "[":
            i = _skip_class(regex, i)
            continue
        if ch == "(":
            named = _JAVA_GROUP.match(regex, i)
            group = {"number": None, "name": None, "alternation": False, "parent": current, "loose": False}
            if named:
                number += 1
                group.update(number=number, name=named.group(1))
                i = named.end()
            elif regex[i + 1:i + 2] == "?":
                i += 2
            else:
                number += 1
                group["number"] = number
                i += 1
            groups.append(group)
            current = group
            continue
        if ch == ")":
            rest = regex[i + 1:i + 4]
            current["loose"] = rest[:1] in ("?", "*") or rest.startswith("{0") or rest.startswith("{,")
            current = current["parent"] or root
        elif ch == "|":
            current["alternation"] = True
        i += 1

    def unset(group: dict) -> bool:
        if group["loose"]:
            return True
        up = group["parent"]
        while up is not None:
            if up["alternation"] or up["loose"]:
                return True
            up = up["parent"]
        return False

    return [(g["name"], g["number"], unset(g)) for g in groups if g["name"]]


def _skip_class(regex: str, i: int) -> int:
    """Index just past the character class that starts at ``i`` (classes may nest)."""
    depth = 0
    start = i
    while i < len(regex):
        ch = regex[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and i > start + 1 and regex[start + 1:i] != "^":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return i
