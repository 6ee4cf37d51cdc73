"""Hand-made graphs with known answers."""

from datetime import datetime

import pytest

from graphloom.__main__ import main
from graphloom.engine import Engine
from graphloom.functions import scalars
from graphloom.operators import onehop, paths, throws
from graphloom.sources import compile_db, schema
from pyspark.sql import functions as F


def graph(spark, edges, nodes=None, throwing=()):
    """Definitions and calls of a graph; edges: (caller, callee) usrs, nodes: usr -> name."""
    nodes = nodes or {x: x for e in edges for x in e}
    defs = spark.createDataFrame([(i, datetime(2024, 1, 1), u, q, u in throwing) for i, (u, q) in enumerate(nodes.items())], "func_def_id long, create_time timestamp, usr string, qualified string, might_throw boolean")
    calls = spark.createDataFrame([(i, a, a in throwing, b, nodes.get(b, b)) for i, (a, b) in enumerate(edges)], "func_call_id long, caller_usr string, caller_might_throw boolean, usr string, qualified string")
    return defs, calls


def steps(df):
    return [r["qualified"] for r in df.orderBy("step").collect()]


def test_call_path(spark):
    g = graph(spark, [("A", "B"), ("B", "T")])
    assert steps(paths.call_path(*g, "A", "T")) == ["A", "B", "T"]
    assert steps(paths.call_path(*g, "A", "T", compat=True)) == ["A", "T"]
    g = graph(spark, [("C", "A"), ("A", "B"), ("B", "C"), ("B", "T")])
    assert steps(paths.call_path(*g, "C", "T")) == ["C", "A", "B", "T"]
    assert steps(paths.call_path(*g, "T", "C")) == []
    with pytest.raises(ValueError):
        paths.call_path(*g, "A", "A")


def test_self_loop_duplicates_dangling(spark):
    nodes = {"A": "A", "B": "B"}
    d, c = graph(spark, [("A", "A"), ("A", "B"), ("A", "B"), ("Z", "B")], nodes)
    assert [r["caller"] for r in onehop.callers_of(d, c, "A").collect()] == ["A"]
    assert [r["caller"] for r in onehop.callers_of(d, c, "B").collect()] == ["A", "A"]
    assert [tuple(r) for r in onehop.dangling_callers(d, c).collect()] == [("Z", 1)]


def test_overloads_and_undefined_target(spark):
    d, c = graph(spark, [("f2", "T")], {"f1": "f", "f2": "f", "T": "T"})
    assert steps(paths.call_path(d, c, "f", "T")) == ["f", "T"]
    d, c = graph(spark, [("A", "U")], {"A": "A"})
    assert steps(paths.call_path(d, c, "A", "U")) == ["A", "U"]
    with pytest.raises(paths.UnknownFunction):
        paths.call_path(d, c, "U", "A")


def test_throw_path(spark):
    g = graph(spark, [("A", "B"), ("B", "C")], throwing=("B",))
    assert steps(paths.throw_path(*g, "A")) == ["A", "B"]
    leaf = graph(spark, [("A", "B")], throwing=("B",))
    assert steps(paths.throw_path(*leaf, "A")) == ["A", "B"]
    assert steps(paths.throw_path(*leaf, "A", compat=True)) == []
    own = graph(spark, [("A", "C")], throwing=("A",))
    assert steps(paths.throw_path(*own, "A")) == ["A"]


SCOPES = "usr string, scope_id int, parent_scope_id int, handler_order int, catch_type string, guards int"


def escaping(spark, thrown, calls=(), scopes=(), bases=(("D", "B"),), again=(), specs=None):
    make = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    out = throws.analyse(make(thrown, "usr string, scope_id int, type string"), make(calls, "usr string, scope_id int, callee string"), make(scopes, SCOPES), make(bases, "derived string, base string"), make(again, "usr string, scope_id int"), make(specs, "usr string, type string") if specs else None)
    return sorted(tuple(r) for r in out.collect())


def test_exception_scopes(spark):
    tried = [("f", 1, 0, None, None, None)]
    assert escaping(spark, [("f", 1, "D")], scopes=[*tried, ("f", 2, 0, 0, "D", 1)]) == []
    assert escaping(spark, [("f", 1, "D")], scopes=[*tried, ("f", 2, 0, 0, "B", 1)]) == []
    assert escaping(spark, [("f", 1, "D")], scopes=[*tried, ("f", 2, 0, 0, "B", 1)], again=[("f", 2)]) == [("f", "B")]
    assert escaping(spark, [("f", 1, "D")], scopes=[*tried, ("f", 2, 0, 0, "...", 1)], again=[("f", 2)]) == [("f", "D")]
    assert escaping(spark, [("f", 1, "D"), ("f", 2, "X")], scopes=[*tried, ("f", 2, 0, 0, "Y", 1)]) == [("f", "D")]
    assert escaping(spark, [("f", 1, "D"), ("f", 2, "X")], scopes=[*tried, ("f", 2, 0, 0, "D", 1)]) == [("f", "X")]


def test_exception_calls_and_ignored(spark):
    assert escaping(spark, [("g", 0, "D")], calls=[("f", 0, "g"), ("g", 0, "f")]) == [("f", "D"), ("g", "D")]
    assert escaping(spark, [("x", 0, "D")], calls=[("f", 0, "n")], specs=[("n", "S")]) == [("f", "S"), ("n", "S"), ("x", "D")]
    e = spark.createDataFrame([("f", "AssertionError"), ("g", "std::bad_alloc"), ("h", "E")], "usr string, type string")
    got = throws.might_throw(spark.createDataFrame([("f",), ("g",), ("h",), ("i",)], "usr string"), e)
    assert {r["usr"]: r["might_throw"] for r in got.collect()} == {"f": False, "g": False, "h": True, "i": False}
    s = throws.summaries(spark.createDataFrame([("h",), ("n",), ("p",)], "usr string"), e, spark.createDataFrame([("n",)], "usr string"))
    assert {r["usr"]: r["behaviour"] for r in s.collect()} == {"h": "Throwing", "n": "Unknown", "p": "NotThrowing"}


def occurrence(tu, kind, name, is_def=False, inside=None, file=None, throws_=False, macro=False, ok=True):
    return (tu, ok, kind, False, is_def, macro, False, name, name, inside, "Function" if inside else None, file or f"/p/{tu}", 1, throws_)


def test_engine(spark, tmp_path, capsys):
    rows = [
        occurrence("a.cc", "Function", "f", True, throws_=True),
        occurrence("a.cc", "Function", "g", inside="f"),
        occurrence("a.cc", "Function", "out", inside="f", file="/elsewhere/x.h"),
        occurrence("a.cc", "Macro", "MAX", True, macro=True),
        occurrence("b.cc", "Function", "f", True),
        occurrence("b.cc", "Function", "g", True),
        occurrence("bad.cc", "Function", "h", True, ok=False),
    ]
    rows = [(f"/p/{r[0]}", *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, schema.OCCURRENCES)
    engine = Engine(spark, str(tmp_path / "store"), "/p/")
    assert engine.project_id == 1
    assert engine.index(df, datetime(2024, 1, 1)) == {"func_definitions": 3, "func_calls": 1, "filepaths": 2}
    assert [r["caller"] for r in engine.callers_of("g").collect()] == ["f"]
    assert {r["usr"]: r["might_throw"] for r in engine.table("func_definitions").collect()} == {"f": True, "g": False, "@macro@MAX": False}
    assert steps(engine.call_path("f", "g")) == ["f", "g"]
    assert engine.index(df, datetime(2024, 1, 2))["func_definitions"] == 0
    assert Engine(spark, str(tmp_path / "store"), "/p/").project_id == 1
    ask = lambda *a: main(["--base", str(tmp_path / "store"), "--root", "/p/", *a], spark)
    assert [ask(*a) for a in (("--callee_of", "f"), ("--callee_of", "g"), ("--callee_of", "no"), ("--caller_of", "g"), ("--caller_of", "f"))] == [0, 0, 1, 0, 1]
    capsys.readouterr()
    assert [ask(*a) for a in (("--callpath", "f;g"), ("--callpath", "f"), ("--callpath", "no;g"), ("--throwpath", "f"), ("--throwpath", "no"))] == [0, 1, 1, 0, 1]
    assert capsys.readouterr().out.splitlines()[:4] == ["BEGIN path f;g", "f", "g", "END path f;g: 2"]
    assert Engine(spark, str(tmp_path / "store"), "/q/").project_id == 2


def test_streaming(spark, tmp_path):
    from graphloom.streaming.stream_ingest import start_ingest

    spark.createDataFrame([("/p/a.cc", *occurrence("a.cc", "Function", "f", True)[1:])], schema.OCCURRENCES).write.parquet(str(tmp_path / "facts"))
    engine = Engine(spark, str(tmp_path / "store"), "/p/")
    start_ingest(engine, str(tmp_path / "facts"), str(tmp_path / "mark"), version=lambda i: datetime(2024, 1, 1)).awaitTermination(120)
    assert [r["usr"] for r in engine.table("func_definitions").collect()] == ["f"]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(scalars.split_parts(F.lit("a;b;"), ";")) == ["a", "b"]
    assert get(scalars.path_request(F.lit(";b"))) is None
    assert get(scalars.simplify_anonymous(F.lit("(anonymous namespace)::f"))) == "(anon ns)::f"
    assert get(scalars.relative_path(F.lit("/p/src/x.cc"), F.lit("/p/"))) == "src/x.cc"
    assert get(scalars.relative_path(F.lit("/p/"), F.lit("/p/"))) == ""
    assert get(scalars.relative_path(F.lit("/pq/x"), F.lit("/p"))) is None
    assert [get(scalars.normal_path(F.lit(p))) for p in ("", "/", "a/..", "/a/../../b", "../../a/./b//c/..")] == [".", "/", ".", "/b", "../../a/b"]
    assert get(scalars.short_name(F.lit("a::b<c::d>"))) == "b"
    assert get(scalars.body_range(scalars.location(F.lit(None), F.lit(1), F.lit(1)), scalars.location(F.lit(None), F.lit(2), F.lit(1)))["begin"]["file_id"]) == -1
    assert get(scalars.clamp_path(F.lit("x" * 2049))) == "FILE_PATH_TOO_LONG"


def test_compile_db(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory": "/p", "file": "a.cc", "command": "/usr/bin/clang++ -c a.cc"}, {"directory": "/p", "file": "b.cc", "arguments": ["gcc", "b.cc"]}]')
    df = compile_db.read_compile_commands(spark, str(tmp_path / "c.json"))
    assert [r["ok"] for r in df.orderBy("position").select(compile_db.compiler_accepted(F.col("arguments")).alias("ok")).collect()] == [True, False]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        compile_db.read_compile_commands(spark, str(tmp_path / "e.json"))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_deeper_than_the_limit_raises(spark, monkeypatch):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(5)], "caller string, callee string")
    start = spark.createDataFrame([("f0",)], "usr string")
    monkeypatch.setattr(paths, "MOST_LEVELS", 5)
    assert paths.levels(edges, start).count() == 6
    monkeypatch.setattr(paths, "MOST_LEVELS", 3)
    assert paths.levels(edges, start, most=3).count() == 4
    with pytest.raises(RuntimeError):
        paths.levels(edges, start)
