import itertools
import random

import duckdb

import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from loomwork.functions import align, commands, policy, stem
from loomwork.functions import text as tx
from loomwork.functions.fuzzy import fuzzy_score
from loomwork.functions.text import redact, seek_lines, truncate_text, truncated
from loomwork.jobs import retrieval
from loomwork.operators import blocks, conversation, events, graph, order, store, vectors
from loomwork.streaming import tables


@pytest.mark.parametrize(("text", "needle", "score"), [("hello", "hl", -99), ("say hello", "hl", 1), ("hello", "HEL", -100), ("abc", "x", None), ("abc", "", 2**31 - 1), ("a_b_c", "abc", -98), (None, "a", None)])
def test_fuzzy(text, needle, score):
    assert fuzzy_score(text, needle) == score


@given(st.text(max_size=60), st.integers(0, 70))
@settings(max_examples=200, deadline=None)
def test_truncate(text, budget):
    out, raw = truncate_text(text, budget), text.encode()
    if len(raw) <= budget or not raw:
        assert out == text
    else:
        head, _, rest = out.partition("…")
        n, tail = rest.split(" chars truncated…", 1) if " chars truncated…" in rest else (None, None)
        if n is not None and n.isdigit() and "…" not in text:
            assert text.startswith(head) and text.endswith(tail) and len(head.encode()) <= budget // 2 and len(tail.encode()) <= budget - budget // 2
            assert int(n) == len(text) - len(head) - len(tail)


def test_truncate_column(spark):
    rows = [(None,), ("",), ("ab",), ("é" * 40,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(truncated("t", 10)).collect()]
    assert got == [None, "", "ab", "éé…36 chars truncated…éé"]


def test_redact(spark):
    rows = [("key sk-" + "a" * 24,), ("AKIA" + "A" * 16,), ("Bearer abcdefghijklmnop1",), ('token = "secret12345"',), ("tokens: none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(redact("t")).collect()]
    assert got == ["key [REDACTED_SECRET]", "[REDACTED_SECRET]", "Bearer [REDACTED_SECRET]", 'token = "[REDACTED_SECRET]"', "tokens: none"]


def test_seek_lines():
    lines = ["a ", " b", "c"]
    assert seek_lines(lines, []) == 0 and seek_lines(lines, ["a", "b"]) == 0 and seek_lines(lines, ["b", "c"]) == 1
    assert seek_lines(["x", " a\u2014b\u00a0\u201cc\u201d"], ['a-b "c"']) == 1
    assert seek_lines(lines, ["c", "c", "c", "c"]) is None and seek_lines(["x", "y", "x"], ["x"], at_end=True) == 2


def test_hops_against_search(spark):
    rng = random.Random(1)
    e = [(str(rng.randrange(60)), str(rng.randrange(60)), "k") for _ in range(70)]
    near = {}
    for a, b, _ in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front, want = {"1", "2"}, {"1", "2"}, {}
    for k in (1, 2, 3):
        front = {y for x in front for y in near.get(x, ())} - seen
        seen |= front
        want |= dict.fromkeys(front, k)
    d = spark.createDataFrame(e, "src_id string, dst_id string, kind string")
    got = graph.within_hops(d, spark.createDataFrame([("1",), ("2",)], "id string"), 3).collect()
    assert {r["id"]: r["hops"] for r in got} == want


def test_budget_keeps_newest(spark):
    rows = [("a", 1, 5), ("a", 2, 6), ("a", 3, 4), (None, 1, 3), (None, 2, 11)]
    got = store.within_budget(spark.createDataFrame(rows, "p string, t int, n long"), ["p"], [store.F.desc("t")], "n", 10).collect()
    assert {(r["p"], r["t"]) for r in got} == {("a", 3), ("a", 2)}


def test_replace_is_rebuild(spark):
    n = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "g")], "id string, name string")
    e = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k")], "src_id string, dst_id string, kind string")
    changed = n.where("name = 'g'").select("id")
    new_n, new_e = n.where("id = 'b'"), e.where("src_id = 'b' and dst_id = 'a'").union(spark.createDataFrame([("b", "a", "k")], e.schema))
    got = graph.replace(n, e, new_n, new_e, changed)
    assert {r["id"] for r in got[0].collect()} == {"a", "b"} and {(r["src_id"], r["dst_id"]) for r in got[1].collect()} == {("a", "b"), ("b", "a")}


def test_knn_drops_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = vectors.knn(v, v.where("vec_id in (1, 3)"), k=9, min_score=0.0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (1, 2, pytest.approx(0.993884)), (1, 3, 0.0)]


def test_roll_back(spark):
    rows = [(1, 0, "turn", 0), (1, 1, "turn", 0), (1, 2, "rollback", 1), (1, 3, "turn", 0), (1, 4, "rollback", 9), (1, 5, "turn", 0), (2, 0, "rollback", 1)]
    got = conversation.roll_back(spark.createDataFrame(rows, "k long, o long, kind string, n int"), "k", "o", "kind", "n").collect()
    assert [(r["k"], r["o"]) for r in got] == [(1, 5)]


def test_budget_by_buckets(spark):
    """Totals by bucket, and rows of the bucket in which the cap falls: as one running sum over all rows."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([0, 1, 5, 9, 40, None])) for t in range(900)] + [("z", 1, 0), ("z", 0, 11)]
    d = spark.createDataFrame(rows, "p string, t int, n int").repartition(3)
    for cap in (0, 10, 300, 10**6):
        want = set()
        for p in ("a", "b", None, "z"):
            total = 0
            for _, t, n in sorted((r for r in rows if r[0] == p), key=lambda r: -r[1]):
                total += n or 0
                if total <= cap:
                    want.add((p, t))
        for width in (1, 37, 1000):
            got = [(r["p"], r["t"]) for r in store.within_budget(d, ["p"], [F.desc("t")], "n", cap, F.floor(F.col("t") / width)).collect()]
            assert set(got) == want and len(got) == len(want)


def test_roll_back_against_a_stack(spark):
    rng, rows, want = random.Random(9), [], set()
    for k in [*range(40), None]:
        left = []
        for o in range(rng.randrange(1, 40)):
            n = rng.choice([0, 1, 1, 2, 5, 100, None, -3])
            if rng.random() < 0.35:
                rows.append((k, o, "rollback", n))
                del left[len(left) - min(len(left), max(0, n or 0)) :]
            else:
                rows.append((k, o, "turn", n))
                left.append(o)
        want |= {(k, o) for o in left}
    got = [tuple(r) for r in conversation.roll_back(spark.createDataFrame(rows, "k long, o long, kind string, n int").repartition(3), "k", "o", "kind", "n").collect()]
    assert set(got) == want and len(got) == len(want)


def test_watermarks(spark):
    """Late input counts as the known one + 1, step by step."""
    rng, rows, want = random.Random(10), [], []
    for k in range(30):
        known, done = -1, -1
        for o in range(rng.randrange(1, 25)):
            kind, value = rng.choice(["enqueue", "enqueue", "succeed", "fail"]), rng.randrange(12)
            rows.append((k, o, kind, value))
            if kind == "enqueue":
                known = value if value > known else known + 1
            elif kind == "succeed":
                done = max(done, known)
        want.append((k, kind, known, done, known > done))
    d = spark.createDataFrame(rows, "key long, seq long, action string, value long").repartition(3)
    assert sorted(tuple(r) for r in store.watermarks(d).select("key", "status", "input", "success", "pending").collect()) == want


def test_delta_tables(spark, tmp_path):
    """Ten and more batches of changes: the table read by merging, runs compacted by size, few rows written for each row that came."""
    rng, now = random.Random(11), {}
    schema, out = "path string, change string, version long", f"{tmp_path}/out"
    frame = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    assert tables.read(spark, out) is None
    came = 0
    for batch in range(14):
        rows = [(f"p{rng.randrange(60)}", rng.choice(["modified", "modified", "removed"]), 1000 * batch + k) for k in range(rng.choice([1, 30, 200]))] if batch != 7 else []
        came += len({r[0] for r in rows})
        for again in (0, 1) if batch in (3, 8) else (0,):  # a batch that is run again replaces itself
            tables.apply(frame(rows), out, batch)
        touched = {}
        for p, change, v in rows:
            touched[p] = max(touched.get(p, -1), v if change != "removed" else -1)
        now = {**now, **touched}
        now = {p: v for p, v in now.items() if v >= 0}
        assert {r["path"]: r["version"] for r in tables.read(spark, out).collect()} == now, batch
    runs = tables.runs(spark, out)
    assert len(runs) <= 3 * 3 and sum(r["written"] for r in tables.history(spark, out).collect()) <= 3 * came
    assert spark.read.parquet(*[f"{out}/runs/{r['run']}" for r in runs]).count() <= came


def test_left_bytes(spark):
    rows = [("", 3), ("abc", 3), ("abcd", 3), ("aéé", 4), ("aé€", 4), ("a😀", 4), ("😀", 4), (None, 4)]
    df = spark.createDataFrame(rows, "t string, n int")
    for n in (3, 4):
        for r in df.select("t", tx.left_bytes(F.col("t"), n).alias("cut")).collect():
            assert r["cut"] == (None if r["t"] is None else r["t"].encode()[:n].decode(errors="ignore"))


BLOCK = "top\n# note\ndef a():\n    x = 1\n\n    if x:\n        y = 2\n        z = 3\n    w = 4\ndef b():\n    v = 5\n"


@pytest.mark.parametrize(
    ("anchor", "levels", "siblings", "header", "most", "want"),
    [
        (7, 1, False, True, 50, [6, 7, 8, 9]),  # one line of the least depth on each side
        (7, 1, True, True, 50, [4, 5, 6, 7, 8, 9]),
        (7, 2, False, True, 50, [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),  # with the comment above; below, up to a second line of the least depth
        (7, 2, False, False, 50, [3, 4, 5, 6, 7, 8, 9, 10, 11]),
        (7, 0, True, True, 50, list(range(1, 12))),
        (7, 0, True, True, 4, [6, 7, 8]),  # line 5 is taken and, blank at an end, goes
        (7, 0, True, True, 1, [7]),
        (12, 0, True, True, 5, []),
    ],
)
def test_indented_block(spark, anchor, levels, siblings, header, most, want):
    x = spark.createDataFrame([(1, BLOCK, anchor, levels, siblings, header, most), (2, None, anchor, levels, siblings, header, most)], "k int, t string, a int, l int, s boolean, h boolean, m int")
    got = blocks.indented_block(x, "k", "t", "a", "l", "s", "h", "m").collect()
    lines = BLOCK.split("\n")
    assert sorted((r["k"], int(r["line"][1:].split(":")[0]), r["line"].split(": ", 1)[1]) for r in got) == [(1, n, lines[n - 1]) for n in want]


def test_word_commands(spark):
    lines = ["ls", "a 'b c' && d", 'x"y"z | w', "a > b", "a $(b)", "a &&", "'open", "", None, "a;b", "it\"'\"s"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    got = sorted((r["id"], r["n"], r["words"]) for r in policy.word_commands(df, "id", "line").collect())
    assert got == [(0, 0, "ls"), (1, 0, "a\nb c"), (1, 1, "d"), (2, 0, "xyz"), (2, 1, "w"), (9, 0, "a"), (9, 1, "b"), (10, 0, "it's")]


def test_non_public(spark):
    from loomwork.functions.policy import non_public

    inside = ["localhost", "127.0.0.1", "10.1.2.3", "172.31.0.1", "169.254.0.9", "198.19.255.255", "255.255.255.255", "224.0.0.1", "0.0.0.0", "::1", "::", "fe80::1%eth0", "fd00::1", "ff02::1", "::ffff:192.168.0.1", "::10.0.0.1"]
    outside = ["8.8.8.8", "172.32.0.1", "198.20.0.0", "2001:db8::1", "::ffff:8.8.8.8", "example.com", "10.0.0", "256.1.1.1", ":", ""]
    rows = spark.createDataFrame([(h,) for h in [*inside, *outside, None]], "host string").select("host", non_public(F.col("host")).alias("x")).collect()
    assert [r.host for r in rows if r.x] == inside and [r.host for r in rows if r.x is False] == outside and rows[-1].x is None


#: Samples that were published with the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
 fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
 vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
 electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
 homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_stop_words_without_jars(spark, monkeypatch, tmp_path):
    """Queries are built where Spark's jars don't lie beside the package; the words are those of Spark's remover."""
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "__init__.py"))
    assert retrieval.stop_words() == sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords("english")})


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    odd = ["a", "is", "x1s", "été", "", "Cats", None, "naïves"]
    got = {r["term"]: r["stem"] for r in stem.stems(spark.createDataFrame([(w,) for w, _ in pairs] + [(w,) for w in odd], "term string")).collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs) and all(got[w] == w for w in odd)
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS term", [[w for w, _ in pairs]])
    assert dict(con.sql(stem.stems_sql("words")).fetchall()) == dict(pairs)


def every_alignment(text, needle):
    """The best score over all places, one by one."""
    seen = text if needle != needle.lower() else text.lower()
    best = None
    for at in itertools.combinations(range(len(text)), len(needle)):
        if any(seen[a] != c for a, c in zip(at, needle, strict=True)):
            continue
        score = 0
        for k, a in enumerate(at):
            before = text[a - 1] if a else ""
            bonus = 8 if text[a].isalnum() and not before.isalnum() else 7 if before.islower() and text[a].isupper() or text[a].isdigit() and before.isalnum() and not before.isdigit() else 0
            gap = a - at[k - 1] - 1 if k else 0
            score += 16 + (2 * bonus if k == 0 else max(bonus, 4) if gap == 0 else bonus - 3 - (gap - 1))
        best = score if best is None else max(best, score)
    return best if needle else None


def test_alignment(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abAB/_.1é") for _ in range(rng.randrange(0, 13))) for _ in range(250)] + ["", "fooBar/baz_qux"]
    needles = ["a", "ab", "aBa", "b1", "//a", "éa", "fb", "zzzz", "abab", ""]
    pairs = [(t, n) for t in texts for n in needles]
    assert align.scores([t for t, _ in pairs], [n for _, n in pairs]) == [every_alignment(t, n) for t, n in pairs]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    n = spark.createDataFrame([(x,) for x in [*needles, needles[0], None]], "needle string")
    got = {(r["i"], r["needle"]): r["score"] for r in align.matches(d, n, "t", block=3).collect()}
    assert got == {(i, x): every_alignment(t, x) for i, t in enumerate(texts) for x in needles if every_alignment(t, x) is not None}
    assert align.scores(["a" * 5000 + "b"], ["aab"]) == [16 * 3 + 2 * 0 + 4 + 4]


def test_head_tail_against_a_buffer(spark):
    rng, rows, want = random.Random(13), [], {}
    for k in range(60):
        most, kept = 11, b""
        data = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.randrange(1, 8))]
        rows += [(k, o, d) for o, d in enumerate(data)] + [(k, 99, None)]
        whole = b"".join(data)
        kept = whole[:5] + whole[5:][-6:] if len(whole) > 5 else whole
        want[k] = kept
    got = conversation.head_tail(spark.createDataFrame(rows, "k int, o int, d binary").repartition(3), "k", "o", "d", 11).collect()
    for k, kept in want.items():
        pieces = sorted((r["part"], r["o"], bytes(r["data"])) for r in got if r["k"] == k)
        assert b"".join(d for _, _, d in pieces) == kept and all(d for _, _, d in pieces)


def test_ranks(spark):
    rng = random.Random(14)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    got = order.ranked(spark.createDataFrame(rows, "i int, v int").repartition(7), F.desc("v"), "i").collect()
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-(r[1] or 0), r[0])))}
    assert {r["i"]: r["rank"] for r in got} == want
    assert order.ranked(spark.createDataFrame([], "i int"), "i").count() == 0


def test_starting_with_keeps_repeated_rows(spark):
    d = spark.createDataFrame([("abc", 1), ("abc", 1), ("b", 2), (None, 3), ("xa", 4), ("", 5)], "t string, n int")
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    got = lambda *x: sorted(r["n"] for r in graph.starting_with(d, "t", names(*x), "name").collect())
    assert got("ab", "a", "abc", None) == [1, 1] and got() == [1, 1, 2, 3, 4, 5] and got("") == [1, 1, 2, 4, 5] and got(None) == [] and got("abcd", "xa") == [4]


def test_command_summaries(spark):
    cases = [
        ("cat 'a b.txt'", [("read", "a b.txt")]),
        ("cat a b", [("unknown", None)]),
        ("cd /srv; cd app/ && cd ../lib && cat x.c", [("read", "/srv/app/../lib/x.c")]),
        ("cd a && cd /b && cat /c/x && cat y", [("read", "/c/x"), ("read", "/b/y")]),
        ("cat x; cd a; cat x", [("read", "x"), ("read", "a/x")]),
        ("cd -P -- -odd && less -p word f", [("read", "-odd/f")]),
        ("cd a", []),
        ("cat f && cat f && ls && cat f", [("read", "f"), ("list", None), ("read", "f")]),
        ("nl -ba && echo x && cat f && echo y", [("read", "f"), ("unknown", None)]),
        ("echo a && nl -ba", [("unknown", None)]),
        ("true", [("unknown", None)]),
        ("true && true", []),
        ("ls | wc -l", [("list", None)]),
        ("wc -l f", [("unknown", None)]),
        ("rg --files a/src | head -n 5", [("list", "a")]),
        ("rg -A 3 needle a/b | xargs sed -i s/a/b/", [("search", "b"), ("unknown", None)]),
        ("fd -t f main lib", [("search", "lib")]),
        ("fd ./lib", [("list", "lib")]),
        ("find a/b -type f", [("list", "b")]),
        ("grep -r -- -x a/b", [("search", "b")]),
        ("git grep -f pats a/b", [("search", "b")]),
        ("git status", [("unknown", None)]),
        ("head -n50 f", [("read", "f")]),
        ("tail -c 5 f", [("unknown", None)]),
        ("awk -F , '{print}' f", [("read", "f")]),
        ("sed -n -e 5p f", [("read", "f")]),
        ("sed s/a/b/ f", [("unknown", None)]),
        ("python3 -c 'import glob; glob.glob(1)'", [("list", None)]),
        ("python3 x.py", [("unknown", None)]),
        ("cat $(ls)", [("unknown", None)]),
        (None, []),
        ("  ", []),
    ]
    got = commands.summaries(spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "id long, line string"), "id", "line").orderBy("id", "n").collect()
    for i, (line, want) in enumerate(cases):
        rows = [r for r in got if r["id"] == i]
        assert [(r["kind"], r["path"]) for r in rows] == want, line
        assert [r["n"] for r in rows] == list(range(len(want)))


def test_items_against_a_replay(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["begin", "end", "message"]), rng.choice([1, 2, None])) for i in range(400)]
    got = events.items(spark.createDataFrame(rows, "id long, s long, what string, call long"), "s", ["id"], "call", "what", F.floor(F.col("id") / 30)).collect()
    running, count, want = {}, {}, {}
    for i, s, what, call in rows:
        begun = running.pop((s, call), None) if what == "end" and call is not None else None
        if begun is None:
            number = count[s] = count.get(s, -1) + 1
            if what == "begin" and call is not None:
                running[s, call] = (i, number)
        else:
            number = begun[1]
        want[i] = ("item.started" if what == "begin" else "item.completed", f"item_{number}", begun and begun[0])
    assert {r["id"]: (r["event"], r["item"], r["begun"]) for r in got} == want and len(got) == len(rows)


def test_user_message(spark):
    rows = [("a ## Q: b ## Q: c \n", False, "b ## Q: c"), (" \t x\n", True, "x"), ("## Q:  ", True, "[Image]"), ("## Q:", False, None), ("", True, "[Image]"), (None, True, "[Image]"), (None, None, None)]
    got = spark.createDataFrame(rows, "text string, images boolean, want string").withColumn("got", tx.user_message(F.col("text"), "## Q:", F.col("images"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
