"""Text functions as columns."""

import pandas as pd
from pyspark.sql import functions as F

#: secrets' patterns in order, with what replaces them.
SECRETS = (
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b", "Bearer [REDACTED_SECRET]"),
    (r"""(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)(["']?)[^\s"']{8,}""", "$1$2$3[REDACTED_SECRET]"),
)


def redact(text):
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def tokens(text):
    """Estimated tokens: bytes / 4, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def left_bytes(text, n):
    """The longest beginning of whole characters that takes at most ``n`` bytes."""
    whole = F.octet_length(text) <= n
    raw = F.substring(F.encode(text, "utf-8"), 1, n)
    back = [F.substring(raw, 1, n - k).cast("string") for k in range(4)]
    return F.when(whole, text).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(b), b) for b in back]))


def truncate_text(text, budget, unit="chars"):
    """Cuts the middle out of a text of more than ``budget`` bytes, at character borders, and names what is gone.

    Half of the budget is for the head. ``unit`` is "chars" (characters cut) or "tokens" (cut bytes / 4).
    """
    raw = text.encode()
    if not raw:
        return ""
    if budget and len(raw) <= budget:
        return text
    head, tail = b"", b""
    if budget:
        left, right = budget // 2, budget - budget // 2
        head = raw[:left].decode(errors="ignore").encode()
        start = len(raw) - right
        while start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
        tail = raw[max(start, len(head)) :]
    gone = len(raw) - budget
    n = len(text) - len(head.decode()) - len(tail.decode()) if unit == "chars" else -(-gone // 4)
    return head.decode() + f"…{n} {unit} truncated…" + tail.decode()


def truncated(text, budget, unit="chars"):
    """``truncate_text`` as a vectorised column."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate_text(t, budget, unit))

    return cut(text)


def host(url):
    """Host of an address: scheme, user, path and port off."""
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\][^/?#]*|[^/?#]*)", 1)


def normal_host(h):
    """Trimmed; brackets, a single port and dots at the end off; lower case."""
    h = F.trim(h)
    inner = F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).when(F.length(h) - F.length(F.replace(h, F.lit(":"))) == 1, F.substring_index(h, ":", 1)).otherwise(h)
    return F.regexp_replace(F.lower(inner), r"\.+$", "")


def indent(line):
    """Width of the blanks a line begins with; a tab counts 4."""
    return F.length(F.replace(F.regexp_extract(line, "^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


#: Code points of dashes, quotes and blanks that a search of lines takes for their ASCII forms.
FOLDED = {
    **dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212), "-"),
    **dict.fromkeys((0x2018, 0x2019, 0x201A, 0x201B), "'"),
    **dict.fromkeys((0x201C, 0x201D, 0x201E, 0x201F), '"'),
    **dict.fromkeys((0x00A0, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000), " "),
}


def seek_lines(lines, pattern, start=0, at_end=False):
    """First place of ``pattern`` in ``lines``: exact, else without blanks at ends, else without blanks on both sides, else with punctuation folded too; None without a match."""
    if not pattern:
        return start
    n = len(lines) - len(pattern)
    if n < 0:
        return None
    for same in (lambda x: x, str.rstrip, str.strip, lambda x: x.strip().translate(FOLDED)):
        want = [same(p) for p in pattern]
        for i in range(n if at_end else start, n + 1):
            if [same(x) for x in lines[i : i + len(pattern)]] == want:
                return i
    return None


def user_message(text, prefix, has_images):
    """What follows the first ``prefix`` of a message, or all of it, without blanks around; ``[Image]`` where nothing is left but images, else null."""
    own = F.when(F.contains(text, F.lit(prefix)), F.substring(text, F.instr(text, prefix) + len(prefix), F.length(text))).otherwise(text)
    return F.coalesce(F.nullif(F.regexp_replace(own, r"^\s+|\s+$", ""), F.lit("")), F.when(has_images, F.lit("[Image]")))
