"""Operator 11: secrets in texts, with the parts of a credential linked.

Strong spans (assignments, access identifiers, hex runs) stand alone. Weak ones are reported only where complementary parts come
together: a short named secret or an opaque run near an identifier, a named secret near an endpoint, and such identifiers and endpoints
themselves. "Near" is an interval join within scopes: both parts lie in one scope (a stretch of text without a blank line) and at most
``reach`` characters apart. A text's parts are found and joined where the text lies, for a batch of documents at once: sorted by start,
with a running maximum of the ends, the nearest part on either side is found by binary search, so no pairs are listed and nothing is shuffled.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import _shared as S

#: Base kinds come first, in this order.
KINDS = ("assign", "access", "hex", "secret", "id", "endpoint")
#: Parts at most so far apart are near.
REACH = 200


def _either(words):
    """Words with their ASCII letters in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_SET = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = "(" + _either("password|passwd|secret|token|api_?key") + ")" + _SET + r"([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
IDENTIFIER = "(" + _either("access_?key_?id|client_?id|user_?name|user|login|account") + ")" + _SET + r"([A-Za-z0-9@+/_.-]{3,})"
ENDPOINT = "(" + _either("endpoint|server|host|base_?url") + ")" + _SET + r"([A-Za-z0-9.:/_-]{4,})|(https?|wss?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+"
#: Opaque runs show a digit, a small and a capital letter.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
BREAK = r"\n[\x20\x09\x0D]*\n"
#: Shortest values of strong and of short named secrets.
LONG, SHORT = 12, 6

#: Texts without any of these can't match; every access identifier, hex run and opaque run lies in a run of 16.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "id": ("keyid", "key_id", "clientid", "client_id", "user", "login", "account"), "endpoint": ("endpoint", "server", "host", "baseurl", "base_url", "://")}
_ASSIGN, _ACCESS, _HEX, _ID, _ENDPOINT, _BREAK = map(re.compile, (ASSIGN, ACCESS, HEX, IDENTIFIER, ENDPOINT, BREAK))


def parts(text):
    """(class, start, end) of the candidates in a text: classes are indices into KINDS, 3 for short named secrets, 6 for opaque runs."""
    out, small = [], text.lower()
    has = lambda kind: any(w in small for w in _WORDS[kind])
    if has("assign"):
        for m in _ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= SHORT:
                out.append((0 if n >= LONG else 3, m.start(), m.end()))
    for run in _RUN.finditer(text):
        a, b = run.span()
        out += [(1, *m.span()) for m in _ACCESS.finditer(text, a, b)]
        out += [(2, *m.span()) for m in _HEX.finditer(text, a, b)]
        word = run[0]
        if b - a >= 20 and re.search("[0-9]", word) and re.search("[A-Z]", word) and re.search("[a-z]", word):
            out.append((6, a, b))
    if len(out):  # nothing else matters without a secret or an access identifier
        if has("id"):
            out += [(4, *m.span()) for m in _ID.finditer(text)]
        if has("endpoint"):
            out += [(5, *m.span()) for m in _ENDPOINT.finditer(text)]
    return out


def nearest(left, right):
    """For each interval (start, end) of ``left`` the nearest of ``right`` and its distance, below 0 where they overlap: (index, gap); no intervals: (-1, a large gap)."""
    n, far = len(left), np.iinfo(np.int64).max // 4
    if not len(right) or not n:
        return np.full(n, -1), np.full(n, far)
    order = np.lexsort((right[:, 1], right[:, 0]))
    start, end = right[order, 0], right[order, 1]
    running = np.maximum.accumulate(end)
    at = np.maximum.accumulate(np.where(end == running, np.arange(len(end)), 0))  # whose end the running maximum is
    k = np.searchsorted(start, left[:, 0], "right")
    before = np.where(k > 0, left[:, 0] - running[k - 1], far)
    after = np.where(k < len(start), start[np.minimum(k, len(start) - 1)] - left[:, 1], far)
    first = before <= after
    return order[np.where(first, at[k - 1], np.minimum(k, len(start) - 1))], np.minimum(before, after)


def link(kind, at, reach):
    """Which parts are reported, and for each part the nearest identifier and endpoint in reach (-1: none). ``at``: (start, end), scopes more than ``reach`` apart."""
    of = lambda *k: np.flatnonzero(np.isin(kind, k))
    alive = np.ones(len(kind), bool)

    def clear(which, others):  # weak parts that overlap another part aren't parts of their own
        alive[which[nearest(at[which], at[others])[1] < 0]] = False

    clear(of(4), of(0, 1, 2, 3))
    clear(of(6), np.r_[of(0, 1, 2, 3, 5), of(4)[alive[of(4)]]])
    live = lambda *k: (x := of(*k))[alive[x]]
    report = np.isin(kind, (0, 1, 2))
    to_id, to_end = np.full(len(kind), -1), np.full(len(kind), -1)

    def join(left, right, to=None):
        i, gap = nearest(at[left], at[right])
        near = gap <= reach
        report[left[near]] = True
        if to is not None:
            to[left[near]] = right[i[near]]

    join(live(0, 2, 3, 6), live(1, 4), to_id)
    join(live(0, 2, 3), live(5), to_end)
    join(live(4), live(0, 2, 3, 6))
    join(live(5), live(0, 2, 3))
    return report, to_id, to_end


SPAN = "struct<kind:string,start:int,end:int>"
SCHEMA = f"doc_id long, spans array<{SPAN}>, credentials array<struct<secret:{SPAN},id:{SPAN},endpoint:{SPAN}>>"


def _find(reach):
    def find(batches):
        for pdf in batches:
            found = [parts(t or "") for t in pdf["text"]]
            rows = np.array([(d, *p) for d, f in enumerate(found) for p in f], np.int64).reshape(-1, 4)
            spans, credentials = [[] for _ in found], [[] for _ in found]
            if len(rows):
                docs, first = np.unique(rows[:, 0], return_index=True)
                shift, base = np.zeros(len(rows), np.int64), 0
                for d, lo, hi in zip(docs, first, [*first[1:], len(rows)], strict=True):
                    text = pdf["text"].iloc[d]
                    ends = np.array([m.end() for m in _BREAK.finditer(text)], np.int64)
                    # one axis for all scopes of the batch, each beyond the reach of the one before
                    shift[lo:hi] = base + np.searchsorted(ends, rows[lo:hi, 2], "right") * (reach + 1)
                    base += len(text) + (len(ends) + 1) * (reach + 1)
                at = rows[:, 2:4] + shift[:, None]
                report, to_id, to_end = link(rows[:, 1], at, reach)
                kind = np.where(rows[:, 1] == 6, 3, rows[:, 1])
                span = lambda i: (KINDS[kind[i]], int(rows[i, 2]), int(rows[i, 3]))
                for i in np.lexsort((kind, rows[:, 2], rows[:, 0])):
                    if report[i]:
                        d = rows[i, 0]
                        spans[d].append(span(i))
                        if to_id[i] >= 0 or to_end[i] >= 0:
                            credentials[d].append((span(i), span(to_id[i]) if to_id[i] >= 0 else None, span(to_end[i]) if to_end[i] >= 0 else None))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": spans, "credentials": credentials})

    return find


def find_credentials(docs, reach=REACH):
    """doc_id, spans (kind, start, end in code points, end exclusive; by start, then kind) and credentials (a secret with the nearest identifier and endpoint in reach) of every row of ``docs(doc_id, text)``.

    Null and empty texts have none. Rows keep their ids, null and repeated ones too; equal texts give equal results.
    Texts are read whole, in time in proportion to their length. Other columns aren't read. An empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_find(reach), SCHEMA)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_credentials(spark, sf_dir):
    found = find_credentials(S.table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op11_credentials": op11_credentials}


def _sql():
    quote = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(name, pattern, text="text"):
        """start and end of all matches: lengths of the pieces between them, added up."""
        return f"""{name} AS (SELECT r, m, s, s + length(m) AS e FROM (SELECT r, m, CAST(sum(length(g) + length(before)) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS s FROM
          (SELECT r, m, g, coalesce(lag(m) OVER (PARTITION BY r ORDER BY k), '') AS before, k FROM (SELECT r, unnest(regexp_extract_all({text}, {quote(pattern)})) AS m, unnest(string_split_regex({text}, {quote(pattern)})) AS g, generate_subscripts(string_split_regex({text}, {quote(pattern)}), 1) AS k FROM d))) WHERE m IS NOT NULL)"""

    near = lambda a, b: f"{a}.r = {b}.r AND {a}.scope = {b}.scope AND greatest({b}.s - {a}.e, {a}.s - {b}.e) <= {REACH}"
    over = lambda a, b: f"{a}.r = {b}.r AND {b}.s < {a}.e AND {b}.e > {a}.s"
    value = f"length(regexp_extract(m, {quote(ASSIGN)}, 2))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      {spans("m_assign", ASSIGN)}, {spans("m_access", ACCESS)}, {spans("m_hex", HEX)}, {spans("m_id", IDENTIFIER)}, {spans("m_end", ENDPOINT)}, {spans("m_opaque", OPAQUE)},
      strong AS (SELECT r, 0 AS k, s, e FROM m_assign WHERE {value} >= {LONG} UNION ALL SELECT r, 1, s, e FROM m_access UNION ALL SELECT r, 2, s, e FROM m_hex UNION ALL SELECT r, 3, s, e FROM m_assign WHERE {value} BETWEEN {SHORT} AND {LONG - 1}),
      named AS (SELECT * FROM strong UNION ALL SELECT r, 5, s, e FROM m_end UNION ALL SELECT r, 4, s, e FROM m_id i WHERE NOT EXISTS (FROM strong b WHERE {over("i", "b")})),
      every AS (SELECT * FROM named UNION ALL SELECT r, 6, s, e FROM m_opaque o WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND NOT EXISTS (FROM named b WHERE {over("o", "b")})),
      p AS (SELECT r, k, s, e, len(regexp_extract_all(substr(text, 1, s), {quote(BREAK)})) AS scope FROM every JOIN d USING (r)),
      reported AS (SELECT r, CASE WHEN k = 6 THEN 3 ELSE k END AS k, s, e FROM p WHERE k < 3
        OR k IN (3, 6) AND EXISTS (FROM p b WHERE b.k IN (1, 4) AND {near("p", "b")}) OR k = 3 AND EXISTS (FROM p b WHERE b.k = 5 AND {near("p", "b")})
        OR k = 4 AND EXISTS (FROM p b WHERE b.k IN (0, 2, 3, 6) AND {near("p", "b")}) OR k = 5 AND EXISTS (FROM p b WHERE b.k IN (0, 2, 3) AND {near("p", "b")})),
      w AS (SELECT r, k, concat_ws(':', list_extract({list(KINDS)!r}, k + 1), s, e) AS w, s FROM reported)
      SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        sha256(coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(w, ',' ORDER BY s, k), '') AS spans FROM d LEFT JOIN w USING (r) GROUP BY r, doc_id"""


ORACLES = {"op11_credentials": _sql()}
