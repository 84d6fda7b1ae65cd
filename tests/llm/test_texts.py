import ast
import json
import random
import tomllib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import docpairs, mixing, packing, parsecheck, spam, tokens

PY = '''"""Module."""
import os

@decorator(x=[1, 2])
def first(a: dict[str, int], b=(1, 2)) -> str:
    """Join the keys.

    Args:
        a: keys to join.
    """
    return "def no(x):" + f"{a['k']}"

class K:
    # def water(): pass
    async def second(self):
        \'\'\'See base class.\'\'\'
        if x:
            return {
        1: 2}
    def third(self): pass
x = 1
'''
JAVA = """
class A {
  /** Adds two numbers and gives their sum. */
  @Override
  public int add(int a, int b) { if (a > 0) { return a + b; } return "}".length(); }
  /** TODO */
  void empty() { }
  int water() { return 1; }
}
"""


def test_islands():
    got = {n: (s, d, c) for n, s, d, c in docpairs.python_islands(PY)}
    assert list(got) == ["first", "K.second", "K.third"]
    assert got["first"][1].startswith("Join the keys.") and got["first"][0] == "def first(a: dict[str, int], b=(1, 2)) -> str"
    assert got["K.second"][1] == "See base class." and got["K.third"][1] is None
    for _, _, code in got.values():
        ast.parse("\n".join(line.removeprefix("    ") if code.startswith("    ") else line for line in code.split("\n")) if "1: 2}" not in code else "pass")
    body = "def f(a):\n" + "    a += 'x'  # more\n" * 90 + "# at the edge\n    b = \"\"\"\nno end\n\"\"\"\n    return b\n"
    islands = list(docpairs.python_islands(body + "# of g\ndef g[T](x: T) -> dict[str, T]: return x\nx = 1\n"))
    assert [(i[0], i[3]) for i in islands] == [("f", body.rstrip()), ("g", "def g[T](x: T) -> dict[str, T]: return x")]
    java = list(docpairs.brace_islands(JAVA))
    far = next(docpairs.brace_islands("/** Adds. */\n" + "public " * 100 + "int add(int a) { return a; }"))
    assert far[0] == "add" and far[3].endswith("return a; }")
    assert [j[0] for j in java] == ["add", "empty"] and java[0][3].endswith('return "}".length(); }')


BRACES = '''
class A {
  String s = "/** No island in a string. */ void no() { }";
  /** Gives the lists by key. */
  @Deprecated(since = "x(1)")
  public <T extends Map<String, List<T>>> Map<String, List<T>> lists(T key, int n) throws E { return make("{"); }
}
// Sum adds the numbers
// one by one.
func (s *Stack) Sum(a []int) int { if len(a) > 0 { return a[0] }; return 0 }
// no function here
var x = 1
/// Reads a line of the file.
@inlinable
func read<T>(from file: T) -> String { return file.next() }
'''
RUBY = "class A\n  # Reads the next\n  # entry.\n  def read_next(n = 1)\n    if n\n      2\n    end\n  end\n\n  def other; end\nend\n"


def test_islands_of_other_languages():
    got = {n: (s, d, c) for n, s, d, c in docpairs.brace_islands(BRACES)}
    assert list(got) == ["lists", "Sum", "read"]
    assert got["lists"][0].startswith("public <T extends") and got["lists"][0].endswith("throws E") and got["lists"][1] == "Gives the lists by key."
    assert got["lists"][2].startswith("@Deprecated") and got["lists"][2].endswith('make("{"); }')
    assert got["Sum"][1] == "Sum adds the numbers\none by one." and got["Sum"][2].endswith("return 0 }")
    assert got["read"][2].startswith("@inlinable")
    assert [(n, d) for n, _, d, _ in docpairs.ruby_islands(RUBY)] == [("read_next", "Reads the next\nentry."), ("other", None)]
    decorated = "@first\n@second(\n    1,\n)\ndef f(): pass\n\nx = 1\ndef g(): pass\n"
    assert [i[3] for i in docpairs.python_islands(decorated)] == ["@first\n@second(\n    1,\n)\ndef f(): pass", "def g(): pass"]


def test_what_the_code_says_adds_nothing(spark):
    code = "@cached\ndef load(first_key: Mapping[str, Packet]) -> LazyResult:\n    pass\n"
    for doc, want in (("Loads the lazy result of a packet mapping.", False), ("Mapping of first keys to packets.", False), ("Loads the lazy result from disk once.", True)):
        df = spark.createDataFrame([("a", doc, "m.load", None, code)], "i string, d string, n string, s string, c string")
        assert bool(docpairs.documented_functions(df, id_col="i", doc_col="d", name_col="n", signature_col="s", code_col="c").count()) is want


def test_shared_sentences_of_any_language(spark):
    empty = ["Da completare più tardi.", "Uzupełnić później.", "Смотри родительский класс.", "Documentação ainda pendente.", "Will be described in the next release."]
    rows = [(f"{k}{i}", doc, f"m.{a}_{b}", None, None) for k, doc in enumerate(empty) for i, (a, b) in enumerate((a, b) for a in ("lade", "carga", "hent") for b in ("wert", "clave"))]
    # one function in many versions shares no sentence with others
    rows += [(f"v{i}", "Legge una volta sola il file.", "m.leggi", None, None) for i in range(9)] + [("one", "Da completare più tardi. Conta le righe non vuote.", "m.conta", None, None)]
    df = spark.createDataFrame(rows, "i string, d string, n string, s string, c string").withColumn("sentence", F.lit(1))
    got = docpairs.documented_functions(df, id_col="i", doc_col="d", name_col="n", signature_col="s", code_col="c")
    assert {r.id for r in got.collect()} == {f"v{i}" for i in range(9)} | {"one"}
    assert docpairs.documented_functions(df.limit(0), id_col="i", doc_col="d", name_col="n", signature_col="s", code_col="c").collect() == []


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        (None, False), ("", False), (" \n\t", False), ("***", False), ("TODO", False), ("todo: document", False), ("Auto-generated method stub.", False), ("See the parent class.", False), ("{@inheritDoc}", False),
        ("Args:\n    key:\n\nReturns:\n", False), (":param key:\n:type key: int\n:return:\n:rtype:\n", False), ("Parameters\r\n----------\r\nkey : int\r\n\r\nReturns\r\n-------\r\n", False), (">>> load_key()\n3", False),
        ("Load key function.", False), ("load_key(key: int)", False), (".. deprecated::", False), ("noqa", False), ("pylint: disable=all", False), (":meta private:", False),
        ("Load the key from disk once.", True), ("TODO: shorten. The cache keeps one entry.", True), ("FIXME later - The cache keeps one entry per open file.", True), ("TODO: rewrite the parser", False), ("TODO - write docs", False), ("See base class for the rest. It retries twice.", True), ("Args:\n    none\n\nReturns:\n    the number of open files", True),
        ("Args:\n    key: where to look first", True), (":param key: where to look first", True), ("@deprecated\nDer Server liest jeden Eintrag.", True), ("@param key where to look first", True), ("Returns\n-------\nint\n    how many bytes remain", True),
    ],
)
def test_described(doc, want):
    assert docpairs.described(doc, "pkg.load_key", "load_keykey: int") is want


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ("Check that the module is importable and return its resolved path.", True), ("Implements the retry method with exponential backoff and returns the last response.", True),
        ("Check whether source rows still match the cached checksum.", True), ("Add a comment to the ticket and return its id.", True), ("Write the docs index to disk and return the number of pages.", True),
        ("Overrides the base limit while a class is loaded.", True), ("Insert comment lines before every branch.", True), ("See whether the source still answers.", True), ("No comment survives, blank lines neither.", True), ("Same as the base method but keeps empty keys.", True),
        ("See base class for the rest.", False), ("See the parent class for more details.", False), ("See module docs.", False), ("Same as above.", False), ("Check the docs.", False), ("Overrides the base class method.", False), ("Implements the interface.", False), ("See the documentation of the base class.", False), ("See class Store for details.", False),
        ("Refer to the method `load` of the superclass.", False), ("Look at the source code instead.", False), ("Add documentation.", False), ("Write docs here.", False), ("Insert description here", False), ("Missing documentation.", False), ("No documentation available.", False), ("Needs a docstring.", False), ("No description is available for this function.", False),
    ],
)
def test_deferrals_end_after_their_target(doc, want):
    assert docpairs.described(doc, "pkg.load_key", "load_keykey: int") is want


def test_documented_functions(spark):
    rows = [("a", "Reads all bytes of it.", "f", None, "def f(x):\n    pass"), ("b", "TODO", "f", "f", None), ("c", None, None, None, None), (None, "Reads all bytes of it.", None, None, None)]
    df = spark.createDataFrame(rows, "i string, d string, n string, s string, c string").withColumn("name", F.lit(1))
    got = docpairs.documented_functions(df, id_col="i", doc_col="d", name_col="n", signature_col="s", code_col="c").collect()
    assert {(r.id, r.signature) for r in got} == {("a", "def f(x)"), (None, None)}
    files = spark.createDataFrame([(1, "a/B.PY", PY), (2, "x.java", JAVA), (3, "x.txt", PY), (4, None, PY), (5, "y.py", None), (6, "z.py", "")], "i long, p string, t string")
    found = docpairs.source_functions(files, id_col="i", path_col="p", text_col="t")
    assert sorted((r.id, r.name) for r in found.collect()) == [("1", "K.second"), ("1", "K.third"), ("1", "first"), ("2", "add"), ("2", "empty")]


GOOD = {
    "py": ["", "x = 1", PY, "if a:\n    b\n# c\nelse:\n    d\n", "@a\n@b(1)\n\ndef f():\n    '''x\ny = (\n'''\n    return 1\n", 's = """\nq\n"""\nt = "a\\\nb"\n', "a = f'{x[\"]\"]}'\nb = [\n1,\n]\n", "a = f\"{x[\"(\"]!r:>{w[\"]\"]}}\"\nb = f'''{{(\n{\n1:%H\n}'''\nc = rf'\\N{d}'\n", "@a\n# c\n@b(\n1)\n\nclass K: x = 1\\\n+ 2\n", "try:\n    a\nexcept E:\n    b\nfinally:\n    c\n"],
    "json": ['{"a": [1, 2, {"b": "x,]\\""}], "c": null}', "[]", "{}", " [1, \"a\"] ", "3", '"s"'],
    "toml": ["", 'a = 1\n[b]\nc = """\n[x\n"""\n[[d]]\ne = [\n[1],\n]\n[[d]]\ne = 2\n', "[a.b]\nx = 1\n[a]\ny = {p = 1}\n", "[a]\nk.l = 1\n"],
}
BAD = {
    "py": ["def (", "x = (1,", "<<<<<<< a\nx = 1\n", "if a:\nb\n", "x = '''open\n", "print 'x'\n", "a = 1\n  b = 2\n", "else:\n    x\n", "x\0y", "def f():\n    return (1]\n"],
    "json": ["", "{", '{"a": 1,}', "[1, 2", "{'a': 1}", '{"a": 1} {"b": 2, "c": 3}', '["a", "b": 1]', "[NaN]", "// c\n{}", '{"a": 1, , "b": 2}', '{"a": "x'],
    "toml": ["a", "a = \n", "[a]\nx = 1\n[a]\ny = 2\n", "a = 1\na = 2\n", '[a]\nx = "open\n', "a = 1\n[a.b]\nc = 2\n", "{\n"],
}


@pytest.mark.parametrize("size", [4096, 7])
def test_unparsable(spark, size):
    rows, bad = [], set()
    for good, table in ((True, GOOD), (False, BAD)):
        for ext, texts in table.items():
            for t in texts:
                rows.append((len(rows), f"d/x.{ext.upper() if len(rows) % 2 else ext}", t))
                if not good:
                    bad.add(len(rows) - 1)
    rows += rows[:9] + [(900, "a.py", None), (901, None, "("), (902, "a.txt", "("), (None, "a.py", "(")]
    df = spark.createDataFrame(rows, "i long, p string, t string").withColumns({"language": F.lit("x"), "n": F.lit(1)})
    got = {int(r.id) for r in parsecheck.unparsable(df, id_col="i", path_col="p", text_col="t", chunk_chars=size).collect()}
    assert got == bad, [rows[i] for i in got ^ bad]
    assert parsecheck.unparsable(df.limit(0), id_col="i", path_col="p", text_col="t").collect() == []


def test_unparsable_beyond_the_parsers_depth(spark):
    n = 30_000
    good = [("a.json", "[" * n + "]" * n), ("a.toml", "a = " + "[" * n + "]" * n), ("a.py", "x = " + "-" * n + "1\n"), ("b.py", "x = " + "not " * n + "1\n"), ("c.toml", "a = " + "[{b = " * 300 + "1" + "}]" * 300), ("f.py", "x = 1" + " + 1" * n)]
    bad = [("b.json", "[" * n), ("c.json", '{"a":' * n + '"x'), ("d.json", "[" * n + "]" * (n - 1)), ("b.toml", "a = " + "[" * n), ("c.py", "x = " + "-" * n + "\n"), ("d.py", "y = (" + "-" * n + "1\n"), ("e.py", "x = " + "not " * n + "\n"), ("g.py", "x = " + "-" * n + "1\n)(\n"), ("d.toml", "a = " + "[{b = " * 300 + "?" + "}]" * 300)]
    df = spark.createDataFrame([(p, p, t) for p, t in good + bad], "i string, p string, t string")
    for size in (parsecheck.CHUNK_CHARS, 1 << 20):
        got = {r.id for r in parsecheck.unparsable(df, id_col="i", path_col="p", text_col="t", chunk_chars=size).collect()}
        assert got == {p for p, _ in bad}


def test_long_files_of_many_chunks(spark):
    """Each file has thousands of chunks; what is wrong lies in one of them, or in the summary of all."""
    unit = "@d\ndef f(a, b=(1, 2)):\n    '''x\ny = (\n'''\n    return {a: [b, f'{a!r:>{b}}']}\n"
    py, js, toml = unit * 20_000, "[" + ",".join(['{"k": [1, "a,]b", null]}'] * 60_000) + "]", "".join(f"[t{i}]\na = [\n1,\n]\n" for i in range(20_000))
    half, middle = len(unit) * 10_000, js.index("null", len(js) // 2)
    good = [("1.py", py), ("2.json", js), ("3.toml", toml)]
    bad = [("4.py", py[:half] + "x = )\n" + py[half:]), ("5.py", py[:half] + "x y\n" + py[half:]), ("6.py", py[:-3]), ("7.json", js[:-1]), ("8.json", js[:middle] + js[middle + 1 :]), ("9.toml", toml + "[t5]\n"), ("10.py", py + "y = '''")]
    df = spark.createDataFrame([(p, p, t) for p, t in good + bad], "i string, p string, t string").repartition(8)
    assert {r.id for r in parsecheck.unparsable(df, id_col="i", path_col="p", text_col="t").collect()} == {p for p, _ in bad}


@pytest.mark.parametrize("language", ["python", "toml", "json"])
def test_summaries_are_associative(language):
    rng = random.Random(3)
    texts = {"python": PY * 2, "toml": 'a = """\n[\n"""\n[b]\nc = [{d = 1}, [2]]\n' * 3, "json": json.dumps([{"a": [1, {"b": "x,]"}]}, [], "s", [[{}]]] * 3)}

    def both(a, b):
        out = []
        for end, left in a:
            r = parsecheck.reduction(language)
            r.feed_all(left + b[end][1])
            out.append((b[end][0], r.left()))
        return out

    for _ in range(60):
        text = list(texts[language])
        if rng.random() < 0.5:
            del text[rng.randrange(len(text))]
        maps = [parsecheck.summary(language, p) for p in parsecheck.cut_chunks(language, "".join(text), rng.randrange(1, 30))]
        if any(end == parsecheck.IN_FIELD for m in maps for end, _ in m):
            continue
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = both(left, m)
        for m in reversed(maps[:-1]):
            right = both(m, right)
        assert left == right and left[0] == parsecheck.summary(language, "".join(text))[0]


def whole(ext, text):
    def no(name):
        raise ValueError(name)

    try:
        {"py": ast.parse, "json": lambda t: json.loads(t, parse_constant=no), "toml": tomllib.loads}[ext](text)
    except (SyntaxError, ValueError):
        return True
    return False


def in_chunks(language, text, size):
    """The steps of the operator on one file."""
    rows = parsecheck._summarised(size, "f", language, "d", text)
    if not rows or rows[0][3] == -1:
        return bool(rows)
    starts = parsecheck._started("f", language, "d", [{"n": r[3], "ends": r[5], "left": r[6]} for r in rows])
    if not starts or starts[0][3] == -1:
        return bool(starts)
    if starts[0][3] == -2:
        return parsecheck.invalid(language, text)
    parts = sorted((p[3:] for s in starts for p in parsecheck._parsed(*s, rows[s[3]][4])), key=lambda p: p[:3])
    return bool(parsecheck._joined("f", language, "d", [dict(zip(("n", "place", "kind", "part"), p, strict=True)) for p in parts]))


@pytest.mark.parametrize("seed", [1, 2])
def test_statements_agree_with_the_whole_parsers(seed):
    """Random damage to valid texts: what chunks and statements say is what a parser of the whole text says."""
    rng = random.Random(seed)
    marks = ["", *"()[]{}'\":,#=", '"""', "'''", "\\\n", "\n", "[[d]]\n", "\r", "f'{x!r:>{y}}'", "f'''{\n1}\n{{'''", "@d\n", "else:\n"]
    for _ in range(900):
        ext = rng.choice(list(GOOD))
        t = rng.choice(GOOD[ext])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(marks) + t[k + rng.choice([0, 0, 1, 3]) :]
        want, language = whole(ext, t), parsecheck.LANGUAGES[ext]
        assert parsecheck.invalid(language, t) is want, (ext, t)
        assert in_chunks(language, t, rng.choice([5, 17, 60])) is want, (ext, t)


def test_rates(spark):
    df = spark.createDataFrame([(1, "a.py", "(", "r"), (2, "b.py", "x", "r"), (3, "c.json", "{}", None)], "i long, p string, t string, r string")
    names = {"id_col": "i", "path_col": "p", "text_col": "t"}
    got = parsecheck.unparsable_rates(df, parsecheck.unparsable(df, **names), repo_col="r", **names)
    assert {tuple(r) for r in got.collect()} == {("r", "python", 2, 1, 0.5), (None, "json", 1, 0, 0.0)}


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        lengths, counts, k = np.sort(rng.choice(40, n, replace=False) + 1), rng.integers(1, 9, n), int(rng.integers(1, 6))
        best = [0.0] + [float("inf")] * n
        for _ in range(k):
            best = [0.0] + [min(best[i] + sum((lengths[j - 1] - lengths[x]) * counts[x] for x in range(i, j)) for i in range(j)) for j in range(1, n + 1)]
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert len(bounds) <= k or n <= k
        assert sum((bounds[np.searchsorted(bounds, a)] - a) * c for a, c in zip(lengths, counts, strict=True)) == best[n]


def test_pack(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([7, 7, rng.randrange(1, 90), 250])) for i in range(900)] + [(5, 7), (None, 3), (901, 0), (902, None)]
    packs = spark.createDataFrame([("s", 100), ("m", 64), ("s", 120), (None, 5), ("z", 0)], "name string, capacity int")
    df = spark.createDataFrame(items, "id long, n int").withColumns({"pack": F.lit("x"), "size": F.lit(1)})
    rows = packing.pack(df, packs, id_col="id", size_col="n", pack_col="name", capacity_col="capacity", buckets=16).collect()
    used, sizes = {}, {}
    for r in rows:
        used[r.pack, r.container] = used.get((r.pack, r.container), 0) + r.size
        sizes.setdefault((r.pack, r.id), []).append((r.start, r.size))
    for name, cap in (("s", 100), ("m", 64)):
        assert max(v for (p, _), v in used.items() if p == name) <= cap
        total = sum(n for i, n in items if i is not None and n)
        boxes = sum(p == name for p, _ in used)
        assert sum(v for (p, _), v in used.items() if p == name) == total and total / (boxes * cap) > 0.9
        for i, n in items:
            if i is not None and i != 5 and n:
                cut = sorted(sizes[name, i])
                assert cut == [(a, min(cap, n - a)) for a in range(0, n, cap)]
    assert {p for p, _ in used} == {"s", "m"}
    assert packing.pack(df.limit(0), packs, id_col="id", size_col="n", pack_col="name", capacity_col="capacity").collect() == []


def test_pack_splits_a_length_by_its_count(spark):
    items = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 50).otherwise((F.col("id") % 40 + 1).cast("int")).alias("n"))
    packs = spark.createDataFrame([("s", 50)], "name string, capacity int")
    args = {"id_col": "id", "size_col": "n", "pack_col": "name", "capacity_col": "capacity"}
    few = packing.pack(items, packs, **args, per_part=20)
    fill = [packing.fill_report(p.select("pack", "container", "size"), packs, pack_col="name", capacity_col="capacity").first() for p in (few, packing.pack(items, packs, **args))]
    assert fill[0] == fill[1] and fill[0].n_pieces == 4000 and fill[0].fullest == 50 and fill[0].fill > 0.97


def test_tokens(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, " \n"), (4, "é" * 5000), (5, "<|endoftext|>")], "i long, t string").withColumn("n_chars", F.lit(1))
    got = {r.i: r.n_tokens for r in tokens.with_tokens(df, text_col="t", keep=["i"]).collect()}
    assert set(got) == {1, 4, 5} and got[1] == 2 and got[4] >= 1000 and got[5] > 1


def test_mix(spark):
    rng = random.Random(5)
    words = {"a": "red green blue".split(), "b": "one two three".split(), "c": "sun moon star".split()}
    docs = [(i, rng.choice([s, s.upper(), f" {s} "]), " ".join(rng.choices(words[s], k=rng.randrange(5, 60)))) for i, s in enumerate(rng.choices("abc", [60, 38, 2], k=900))]
    docs += [(1000 + i, [None, "zz", " "][i % 3], " ".join(rng.choices(words["c"], k=30))) for i in range(40)] + [(2001, "a", None), (2002, "a", " "), (None, "a", "x")]
    targets = spark.createDataFrame([("A ", 0.3, 2), ("b", 0.5, 3), ("c", 0.1, 2), ("none", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"id": F.lit(1), "n_tokens": F.lit(1), "bin": F.lit("x")})
    chosen, shares = mixing.mix(df, targets, id_col="doc_id", source_col="source", text_col="text")
    rows, report = chosen.collect(), {r.source: r for r in shares.collect()}
    assert set(report) == {"a", "b", "c", "none"}
    for name in "ab":
        r = report[name]
        used = sum(x.n_tokens * x.repeats for x in rows if x.source == name)
        assert used == r.labelled_tokens and abs(used - r.goal_tokens) < 60
    cap = {"a": 2, "b": 3, "c": 2}
    assert all(1 <= x.repeats <= cap.get(x.source, 1) for x in rows) and len({x.id for x in rows}) == len(rows)
    assert {x.membership for x in rows if x.source in cap} == {"labelled"} and {x.membership for x in rows if x.id >= 1000} == {"soft"}
    assert report["c"].labelled_tokens == 2 * report["c"].available_tokens  # short: every document at its cap
    # the documents of other sources and of none fill what it lacks
    assert report["c"].soft_tokens > 200 and report["none"].labelled_tokens == 0 and report["a"].soft_tokens + report["b"].soft_tokens < 100
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1.0, abs=1e-3)
    assert report["a"].distance_after < report["a"].distance_before
    nothing = mixing.mix(df.limit(0), targets, id_col="doc_id", source_col="source", text_col="text")
    assert nothing[0].collect() == [] and nothing[1].count() == 4
    none = mixing.mix(df, targets.limit(0), id_col="doc_id", source_col="source", text_col="text")
    assert none[0].collect() == [] and none[1].collect() == []


def test_classifier_on_held_out_documents():
    rng = np.random.default_rng(1)
    truth = rng.dirichlet(np.full(mixing.FEATURES, 0.05), size=4)
    draw = lambda k, n: rng.multinomial(n, truth[k])
    sums = np.stack([sum(draw(k, 80) for _ in range(50)) for k in range(4)])
    held = [(k, mixing._packed(draw(k, 60))) for k in range(4) for _ in range(30)]
    packed, labels = [x for _, x in held], np.array([k for k, _ in held])
    fit, quality = mixing.Classifier(mixing.log_likelihoods(sums), np.full(4, 0.25)).tempered(packed, labels)
    p = fit.posteriors(packed)
    assert quality["accuracy"] == np.mean(p.argmax(axis=1) == labels) > 0.95 and np.allclose(p.sum(axis=1), 1)
    # labels that the texts do not tell leave the prior
    vague, quality = mixing.Classifier(mixing.log_likelihoods(sums), np.full(4, 0.25)).tempered(packed, rng.integers(0, 4, len(labels)))
    assert quality["calibration_error"] < 0.2 and vague.posteriors(packed).max() < 0.6


def test_rates_and_edges():
    tokens = np.array([[100.0, 0.0], [0.0, 50.0], [30.0, 30.0]])
    rate = mixing.fitted_rates(tokens, np.array([2.0, 1.0, 1.0]), np.array([180.0, 70.0]))
    assert np.abs(rate @ tokens - [180, 70]).max() < 1 and (rate >= 0).all() and (rate <= [2, 1, 1]).all()
    # one giant document and many small ones: the giant does not fit, and the small ones make up for it
    edges = mixing.partial_edges({15: {3: 40_000}, 5: {b: 40 for b in range(1000)}}, 0.4)
    assert edges[15] == 3 and abs(sum(40 for b in range(1000) if b < edges[5]) - 32_000) <= 20


KNOWN = frozenset("the a of and to in is it that for on with as so if when then than but or at by be are was will which who this these they we you your their its once more most not no has have can each every any one before after while".split())
PROSE = "The cache keeps one entry per key and drops it when the session ends. Older readers still expect the last value, so it is written once more before the file closes. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PROSE * 1, False), ("```python\n" + "list.add(1)\n" * 60 + "```\n" + PROSE, False), ("ok", False), ("", False),
        ("cheap hosting buy cheap hosting best cheap hosting " * 12, True), ("\n".join(f"https://a{i}.example/x/{i}" for i in range(40)), True),
        ("vote, handle, catalog, buffer, channel, script, row, list, router, item, fragment, pool, replica, format, counter, vector, " * 3, True),
        (PROSE + "\n\n" + "\n".join(f"SKU AB-{i} | binding slot | tags: reader, batch, method, update" for i in range(40)), True),
        ("Get feature sensor online, get feature sensor now, feature sensor for all. feature sensor: the best feature sensor in town. " * 6, True),
        (PROSE + "See http://a.example/b and [c](https://d.example/e) for more.", False),
    ],
)
def test_spam(text, want):
    stuffed, link, _ = spam.spam_shares(["x", text, PROSE], KNOWN)
    assert bool(stuffed[1] + link[1] > spam.SHARE) is want


ADVERT = "If you are in need of a new sensor for the old house then we have the one that you want and it will be with you by the end of the week or the next, which is more than any of the other shops in town can say of their own, as most of them do not even have it in store at all."


def test_spam_of_long_blocks():
    assert 60 <= len(ADVERT.split()) <= 70
    rng = random.Random(2)
    long = " ".join(rng.choices(["and", "of", "the", "when", "it", "is"] * 15 + [f"{a}{b}{c}o" for a in "bcdfgklm" for b in ("an", "er", "ist", "ul") for c in "npstr"], k=1500))
    jitter = " ".join(f"{ADVERT} {'So it is. ' * (i % 3)}" for i in range(50))
    for text in (" ".join([ADVERT] * 50), " ".join([ADVERT] * 3), jitter, " ".join([long] * 4)):
        stuffed, link, _ = spam.spam_shares(["x", text, PROSE], KNOWN)
        assert stuffed[1] > spam.SHARE and stuffed[2] == 0
    pattern = " ".join(f"If the {a} has no {b}, the empty {c} is used and a warning names the {d}." for a, b, c, d in ("credit anchor log value".split(), "marker payload notice snapshot".split(), "flag resolver lock kernel".split()))
    assert spam.spam_shares([pattern], KNOWN)[0][0] == 0
    assert not any(spam.spam_shares([f"{ADVERT} {PROSE}", f"{ADVERT} {PROSE} {ADVERT} {PROSE}"], KNOWN)[0])  # once, and a copy


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("https://a.example/x", True), ("https://a.example/x\nhttps://b.example/y http://c.example", True), ("#sale #sensor", True), ("#Cheap-Sensor", True), ("Tags: sensor, relay", True), ("see https://a.example/x", True), ("#tag https://a.example", True),
        ("Fixed in #12.", False), ("# Overview", False), ("Reads one entry.", False), ("ok", False), ("```\n#tag\n```", False), ("```\nhttps://a.example/x\n```", False), ("C# and F#", False), ("Uses the tag #x", False), ("", False),
    ],
)
def test_spam_of_few_words(text, want):
    for texts in ([text], ["x", text, PROSE]):
        stuffed, link, _ = spam.spam_shares(texts, KNOWN)
        k = texts.index(text)
        assert bool(stuffed[k] + link[k] > spam.SHARE) is want and stuffed[k] + link[k] <= 1


def test_spam_of_neighbouring_texts():
    sentence = "Two option objects compare equal when their relay and policy fields match."
    alone = spam.spam_shares([sentence], KNOWN)
    copies = spam.spam_shares([sentence] * 20, KNOWN)
    assert alone[0][0] == 0.0 and not copies[0].any()  # a pair does not recur over the end of a text


@pytest.mark.parametrize(
    "text",
    [
        "Кэш хранит одну запись для каждого ключа и удаляет её, когда сеанс закрывается. Старые читатели всё ещё ждут последнего значения, поэтому перед закрытием файла оно записывается ещё раз.",
        "Η μνήμη κρατά μία εγγραφή για κάθε κλειδί και την αφαιρεί όταν τελειώνει η σύνοδος. Οι παλιοί αναγνώστες περιμένουν ακόμη την τελευταία τιμή, γι' αυτό γράφεται ξανά πριν κλείσει το αρχείο.",
        "缓存为每个键保存一个条目，并在会话结束时将其删除。旧的读取者仍然需要最后的值，因此在文件关闭之前会再写入一次。",
        "キャッシュはキーごとに一つの項目を保持し、セッションが終わるとそれを削除します。古い読み手はまだ最後の値を待っているので、ファイルが閉じる前にもう一度書き込まれます。",
        "Pamięć podręczna trzyma jeden wpis na każdy klucz i usuwa go, gdy sesja się kończy. Starsi czytelnicy wciąż oczekują ostatniej wartości, dlatego jest ona zapisywana jeszcze raz przed zamknięciem pliku.",
        "Önbellek her anahtar için bir kayıt tutar ve oturum bittiğinde onu siler. Eski okuyucular hâlâ son değeri beklediği için dosya kapanmadan önce bir kez daha yazılır.",
        "Välimuisti säilyttää yhden tietueen avainta kohti ja poistaa sen istunnon päättyessä. Vanhat lukijat odottavat yhä viimeistä arvoa, joten se kirjoitetaan vielä kerran ennen tiedoston sulkemista.",
        "تحتفظ الذاكرة بإدخال واحد لكل مفتاح وتحذفه عندما تنتهي الجلسة. لا يزال القراء القدامى يتوقعون القيمة الأخيرة، لذلك تكتب مرة أخرى قبل إغلاق الملف.",
        "कैश हर कुंजी के लिए एक प्रविष्टि रखता है और सत्र समाप्त होने पर उसे हटा देता है। पुराने पाठक अभी भी अंतिम मान की अपेक्षा करते हैं, इसलिए फ़ाइल बंद होने से पहले उसे एक बार फिर लिखा जाता है।",
        "캐시는 키마다 하나의 항목을 보관하고 세션이 끝나면 그것을 삭제합니다. 오래된 독자는 여전히 마지막 값을 기다리므로 파일이 닫히기 전에 한 번 더 기록됩니다.",
        "La cache conserva una voce per ogni chiave e la elimina quando la sessione finisce. I lettori più vecchi aspettano ancora l'ultimo valore, quindi viene scritto un'altra volta prima che il file si chiuda.",
        "A gyorsítótár kulcsonként egy bejegyzést tart, és törli, amikor a munkamenet véget ér. A régi olvasók még várják az utolsó értéket, ezért a fájl bezárása előtt még egyszer kiírja.",
    ],
)
def test_prose_of_languages_that_are_not_known(text):
    for texts in ([text], [text + " " + PROSE, text, PROSE]):
        for known in (KNOWN, frozenset()):
            shares = spam.spam_shares(texts, known)
            assert not (shares[0] + shares[1] > spam.SHARE).any()


@pytest.mark.parametrize("words", ["кэш ключ файл сеанс запись буфер канал скрипт список узел пул реплика формат счётчик вектор метка", "önbellek anahtar dosya oturum kayıt tampon kanal betik liste düğüm havuz kopya biçim sayaç vektör etiket"])
def test_lists_of_languages_that_are_not_known(words):
    shares = spam.spam_shares([", ".join(words.split()), "\n".join(words.split())], KNOWN)
    assert (shares[0] > spam.SHARE).all()


def test_phrases_with_words_exchanged_at_long_gaps():
    rng = random.Random(4)
    frame = "for all old town people who want to buy one new red sensor this week our best shop has free relay parts".split()
    filled = [f"{a}{b}o" for a in "bcdfgklmnprst" for b in ("an", "er", "ist", "ul", "om", "ak")]
    text = " ".join(w if k % 6 else rng.choice(filled) for _ in range(40) for k, w in enumerate(frame))
    shares = spam.spam_shares([text, PROSE], KNOWN)
    assert shares[0][0] > spam.SHARE and shares[0][1] == 0 and shares[2][0] > spam.PERIODIC


def test_function_words_are_learned(spark):
    rng = random.Random(6)
    nouns = [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in ("an", "er", "ist", "ul", "om", "ak") for c in ("o", "en", "is", "um")]
    glue = {"en": "the of and to in is".split(), "ru": "и в на не что с".split()}
    rows = [(lang, " ".join(w for _ in range(25) for w in (rng.choice(own), rng.choice(nouns), rng.choice(own), rng.choice(nouns)))) for lang, own in glue.items() for _ in range(70)]
    rows += [(" EN-us", rows[0][1]), ("xx", "zu wenig davon"), (None, "nor of this"), ("en", None), ("en", " ")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("word", F.lit("clash"))
    found = spam.function_words(df, text_col="text", lang_col="lang")
    assert found and found <= {w for own in glue.values() for w in own} and all(found & set(own) for own in glue.values())
    assert spam.function_words(df.limit(0), text_col="text") == frozenset()
    assert spam.function_words(df.where("lang = 'xx'"), text_col="text", lang_col="lang") == frozenset()


def test_spam_pages(spark):
    spammy = "buy cheap sensor " * 50
    df = spark.createDataFrame([(1, spammy), (1, spammy), (2, PROSE), (3, None), (4, "  "), (None, spammy), (5, "http://a.example/x\x00 " * 30)], "i long, t string").withColumn("id", F.lit(7))
    assert sorted((r.id is None, r.id or 0) for r in spam.spam_pages(df, id_col="i", text_col="t").collect()) == [(False, 1), (False, 1), (False, 5), (True, 0)]
    assert spam.spam_pages(df.limit(0), id_col="i", text_col="t").collect() == []
