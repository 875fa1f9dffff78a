"""Regular expressions in a dialect that Java and RE2 read alike.

Fixed values: character classes of Unicode white space, word characters and digits, and the line
patterns whose matches results depend on. A word boundary after a keyword is written as "a non-word
character or the end", so no look-around is needed.
"""

from __future__ import annotations

import re

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NWS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
#: The characters of WS.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"
STOP = "[.!?。！？]"

TOKEN = rf"{W}{{1,4}}|[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x85\p{{Z}}]"
WORD = f"{W}+"
BLANK = rf"^{WS}*$"

_STAMP = rf"{D}{{4}}-{D}{{2}}-{D}{{2}}[ T]{D}{{2}}:{D}{{2}}:{D}{{2}}[.,{D}]*Z?"

#: (label, setting that turns it on, ignores case, pattern), in the order in which they are tried.
NOISE = (
    ("timestamp", "drop_timestamps", False, rf"^{WS}*\[?{_STAMP}\]?{WS}*$"),
    ("progress_bar", "drop_progress_bars", False, rf"^[\t-\r\x1c-\x20\x85\p{{Z}}░▒▓█=>\-#.\[\]]*{D}{{1,3}}{WS}*%{WS}*$"),
    ("separator", "drop_separators", False, r"^[\t-\r\x1c-\x20\x85\p{Z}\-=_|*~#.<>+]{3,}$"),
    ("status_msg", "drop_status_messages", True, rf"^{WS}*(?:connecting|connected to|reconnecting|disconnected|waiting|loading|initializing|please wait|establishing)(?:{NW}.*)?$"),
    ("sql_stats", "drop_status_messages", True, rf"^{WS}*(?:rows?{WS}+(?:affected|returned)|query{WS}+(?:ok|executed)|{D}+{WS}+rows?{WS}+in{WS}+set)(?:{NW}.*)?$"),
    ("log_level", "drop_log_levels", True, rf"^{WS}*\[?(?:debug|trace|info|notice)\]?{WS}*[:\-]?{WS}*$"),
    ("stack_frame", "drop_stack_trace_frames", True, rf"^{WS}{{2,}}at{WS}+{NWS}"),
)

LOG_PREFIX = rf"^{WS}*{_STAMP}{WS}*[-|]?{WS}*(?:pid[=:]?{WS}*{D}+{WS}*[-|]?{WS}*)?(?:thread(?:_|-|{WS})*id[=:]?{WS}*{D}+{WS}*[-|]?{WS}*)?"
TABLE_ROW = rf"^{WS}*(?:\||[\p{{L}}\p{{N}}_.:/-]+{WS}*[,|]{WS})"
#: A double-quoted literal; possessive, so that Java keeps no stack for long ones.
LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
LITERAL_RE2 = r'"[^"\\]*(?:\\.[^"\\]*)*"'

#: (label, severity, pattern), in the order in which they are tried; all ignore case.
RISKS = (
    ("SQL Injection", 1, rf"sql(?:{WS}|[_-])?injection|sqli(?:{NW}|$)|union{WS}+select"),
    ("Command Injection", 1, rf"command(?:{WS}|[_-])?injection|os(?:{WS}|[_-])?command|rce(?:{NW}|$)|remote code"),
    ("Cross-Site Scripting (XSS)", 2, rf"(?:^|{NW})xss(?:{NW}|$)|cross(?:{WS}|[_-])?site(?:{WS}|[_-])?scripting"),
    ("Path Traversal", 2, rf"path(?:{WS}|[_-])?traversal|directory(?:{WS}|[_-])?traversal|\.\./"),
    ("Sensitive Data / Cleartext", 2, rf"cleartext|plain(?:{WS}|[_-])?text{WS}+password|unencrypted"),
    ("Weak / Default Credentials", 3, rf"weak(?:{WS}|[_-])?password|default(?:{WS}|[_-])?credential|anonymous{WS}+login"),
    ("Open Port / Service", 4, rf"(?:^|{NW})port{WS}+{D}+{WS}+open|open{WS}+port|(?:^|{NW})open{NW}.*tcp"),
    ("Outdated Component", 3, rf"outdated|end(?:{WS}|[_-])?of(?:{WS}|[_-])?life|deprecated{WS}+version"),
    ("Misconfiguration", 3, rf"misconfigur|improper{WS}+config|insecure{WS}+config|directory{WS}+listing"),
)
SEVERITY = {1: ("CRITICAL", "🔴"), 2: ("HIGH", "🟠"), 3: ("MEDIUM", "🟡"), 4: ("LOW", "🟢"), 5: ("INFO", "ℹ️")}

URL = r"https?://[^\t-\r\x1c-\x20\x85\p{Z}\"'<>]+"
#: The address is group 2; a word character before or behind it is no boundary.
HOST = rf"(^|{NW})((?:{D}{{1,3}}\.){{3}}{D}{{1,3}}(?::{D}+)?)(?:{NW}|$)"
CVE = rf"CVE-{D}{{4}}-{D}{{4,7}}"

STOPWORDS = "the a an and or of to in is are was were for on with as by at this that it be has have had i you we they he she".split()


def java(pattern: str, ignore_case: bool = False) -> str:
    """For Spark: only \\n ends a line; case is ignored by Unicode rules."""
    return ("(?diu)" if ignore_case else "(?d)") + pattern


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For DuckDB, as the body of a single-quoted literal."""
    return ("(?i)" if ignore_case else "") + pattern.replace("'", "''")


#: Escapes that Java reads otherwise than Python, by what stands for them (without brackets, and negated).
_CLASSES = {"s": (WS[1:-1], False), "S": (WS[1:-1], True), "w": (W[1:-1], False), "W": (W[1:-1], True), "d": (D, False), "D": (D, True)}
_EDGE = {"b": rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))", "B": rf"(?:(?<={W})(?={W})|(?<!{W})(?!{W}))", "Z": r"\z", "v": r"\x0B"}


def from_user(pattern: str | re.Pattern) -> str:
    """A Python pattern (text, or compiled with flags) for Spark, with the meaning that Python gives it.

    Raises ValueError for what Java can't say: bytes patterns, ASCII and locale flags, conditionals, named characters.
    """
    made = re.compile(pattern)
    if isinstance(made.pattern, bytes) or made.flags & (re.ASCII | re.LOCALE):
        raise ValueError(f"only Unicode patterns of texts are taken: {pattern!r}")
    source, out, at, inside = re.sub(r"^\(\?[aiLmsux]+\)", "", made.pattern), [], 0, False
    while at < len(source):
        c, two = source[at], source[at : at + 2]
        if c == "\\":
            letter = two[1]
            if letter in _CLASSES:
                body, negated = _CLASSES[letter]
                out.append(f"[^{body}]" if negated else body if inside else f"[{body}]")
            elif letter in _EDGE and not (inside and letter in "bBZ"):
                out.append(_EDGE[letter])
            elif letter == "N" or letter == "0":
                raise ValueError(f"\\{letter} has no counterpart in {pattern!r}")
            elif letter == "U":
                out.append(f"\\x{{{source[at + 2 : at + 10]}}}")
                at += 8
            else:
                out.append(r"\x08" if letter == "b" else two)
            at += 2
            continue
        if inside:
            out.append("\\" + c if c in "[&" else c)
            if c == "]":
                inside = False
        elif c == "[":
            inside = True
            lead = re.match(r"\[\^?\]?", source[at:])[0]
            out.append(lead.replace("]", r"\]"))
            at += len(lead)
            continue
        elif source.startswith("(?(", at):
            raise ValueError(f"conditionals have no counterpart in {pattern!r}")
        elif source.startswith("(?P<", at) or source.startswith("(?P=", at):
            name = re.match(r"\(\?P[<=](\w+)", source[at:])[1]
            out.append(f"(?<{name.replace('_', 'U')}" if source[at + 3] == "<" else rf"\k<{name.replace('_', 'U')}>")
            at += 4 + len(name) + (source[at + 3] == "=")
            continue
        else:
            out.append(c)
        at += 1
    on = "".join(letter for flag, letter in ((re.IGNORECASE, "iu"), (re.MULTILINE, "m"), (re.DOTALL, "s"), (re.VERBOSE, "x")) if made.flags & flag)
    return f"(?d{on})" + "".join(out)
