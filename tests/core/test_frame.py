import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import framewright as fw
from framewright import Frame, Series


@pytest.fixture()
def teams(spark):
    return Frame.create([{"team": "A", "points": 1, "rev": None}, {"team": "A", "points": 3, "rev": 5}, {"team": "B", "points": 2, "rev": 1}, {"team": None, "points": 9, "rev": 2}])


def test_basics(teams):
    assert teams.shape == (4, 3) and teams.columns == ["team", "points", "rev"]
    assert teams.dropna().shape == (2, 3)
    assert teams.fillna({"rev": 0}).get("rev").to_list() == [0, 5, 1, 2]
    assert teams.head(2).to_dict("list")["points"] == [1, 3] and teams.tail(1).to_records()[0]["points"] == 9
    assert teams.iloc(-1)["points"] == 9 and teams.iloc([2, 0]).get("points").to_list() == [2, 1]
    assert teams.loc(1)["points"] == 3 and teams.at(2, "team") == "B"
    assert teams.nunique() == {"team": 2, "points": 4, "rev": 3} and teams.nunique(False)["team"] == 3
    assert teams.dtypes() == {"team": "string", "points": "number", "rev": "number"}
    with pytest.raises(KeyError):
        teams.drop("nope")


def test_groupby(teams):
    assert teams.groupby("team").agg({"points": "mean", "rev": "count"}).to_records() == [{"team": "A", "points": 2.0, "rev": 1}, {"team": "B", "points": 2.0, "rev": 1}]
    assert [r["team"] for r in teams.groupby("team", dropna=False).size().to_records()] == ["A", "B", None]
    assert teams.groupby("team", as_index=True).sum().loc("A") == {"points": 4.0, "rev": 5.0}
    assert teams.groupby("team", dropna=False, sort=False).count().get("team").to_list() == ["A", "B", None]
    assert teams.groupby("team").agg({"points": lambda v: v.max() - v.min()}).get("points").to_list() == [2.0, 0.0]
    with pytest.raises(ValueError):
        teams.groupby("team").agg({"points": "median"})


def test_sort_and_counts(teams):
    assert teams.sort_values("team", ascending=False, na_position="first").get("team").to_list() == [None, "B", "A", "A"]
    assert teams.sort_values(["team", "points"], [True, False], limit=2).get("points").to_list() == [3, 1]
    assert teams.value_counts("team").to_records() == [{"team": "A", "count": 2}, {"team": "B", "count": 1}]
    assert teams.value_counts("team", normalize=True, dropna=False, limit=1).to_records() == [{"team": "A", "proportion": 0.5}]
    assert teams.get("team").value_counts().to_dict() == {"A": 2, "B": 1}
    assert teams.drop_duplicates("team", keep="last").get("points").to_list() == [3, 2, 9]
    assert teams.drop_duplicates("team", keep=False).get("points").to_list() == [2, 9]
    assert Frame.create({"x": ["a", "b", "c"]}, index=[20, 30, 10]).sort_index().get("x").to_list() == ["c", "a", "b"]


def test_merge_and_concat(spark):
    a, b = Frame.create([{"id": 1, "n": "x"}, {"id": None, "n": "y"}, {"id": 3, "n": "z"}]), Frame.create([{"id": None, "n": "q"}, {"id": 1, "n": "r"}, {"id": 7, "n": "s"}])
    assert fw.merge(a, b, "id").to_records() == [{"id": 1, "n_x": "x", "n_y": "r"}, {"id": None, "n_x": "y", "n_y": "q"}]
    assert [r["n_y"] for r in a.merge(b, "id", "left").to_records()] == ["r", "q", None]
    assert [r["id"] for r in a.merge(b, "id", "right").to_records()] == [1, None, 7]
    assert [r["id"] for r in a.merge(b, "id", "outer").to_records()] == [1, None, 3, 7]
    assert fw.concat([a, b.rename({"n": "m"})]).to_records()[3] == {"id": None, "n": None, "m": "q"}
    assert fw.concat([a, b], axis=1).columns == ["id", "n", "id_1", "n_1"] and fw.concat([a, b], axis=1).shape == (3, 4)


def test_pivot(spark):
    """Against counts in plain Python, over a seeded table."""
    rng = random.Random(12)
    rows = [{"k": rng.choice("vwz"), "h": rng.choice(["n", "o", None]), "s": rng.randrange(1, 9)} for _ in range(40)] + [{"k": "y", "h": "n", "s": 4}]
    f, sums = Frame.create(rows), Counter()
    for r in rows:
        if r["h"]:
            for key in ((r["k"], r["h"]), (r["k"], "All"), ("All", r["h"]), ("All", "All")):
                sums[key] += r["s"]
    p = f.pivot_table("k", "s", columns="h", aggfunc="sum", fill_value=0, margins=True)
    assert p.columns == ["k", "n", "o", "All"] and p.to_records() == [{"k": k, **{h: sums[k, h] for h in ("n", "o", "All")}} for k in ("v", "w", "y", "z", "All")]
    nulls = f.pivot_table("k", "s", columns="h", aggfunc="sum", dropna=False)
    assert nulls.columns == ["k", "n", "o", "null"]
    assert f.pivot_table("k", "s", margins=True, aggfunc="sum").to_records()[-1] == {"k": "All", "s": sum(r["s"] for r in rows)}
    spread = f.pivot_table("k", "s", columns="h", aggfunc=lambda v: v.max() - v.min(), margins=True)
    own = [r["s"] for r in rows if r["h"]]
    assert spread.to_records()[-1]["All"] == max(own) - min(own)
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    with pytest.raises(ValueError):
        f.pivot_table("h", "k", columns="s", aggfunc="count")
    spark.conf.unset("spark.sql.pivotMaxValues")


def test_cells(spark):
    f = Frame.create({"city": ["a", "b", None], "v": [1, 12, None]})
    assert f.isin(["a", 12, None]).values() == [[True, False], [False, True], [True, True]]
    assert f.clip(2, 10).get("v").to_list() == [2, 10, None]
    assert f.replace({"a": "z"}).get("city").to_list() == ["z", "b", None] and f.replace([1, None], 5).get("v").to_list() == [5, 12, 5]
    assert f.astype("string").get("v").to_list() == ["1", "12", None]
    s = Series.create(["", " 7 ", "0x10", "abc", "1d", "2e3"])
    assert s.astype("number").to_list() == [0, 7, 16, None, None, 2000]
    assert Series.create(["yes", "No", "", "maybe"]).astype("boolean").to_list() == [True, False, False, True]
    assert f.applymap(lambda c: c).shape == (3, 2) and Series.create([1, 2]).map(lambda v: v * 2).to_list() == [2, 4]
    assert Frame.create({"a": [1, 2], "b": [10, 20]}).apply("sum").to_dict() == {"a": 3, "b": 30}
    assert Frame.create({"a": [1, 2], "b": [10, 20]}).apply(lambda r: r["a"] + r["b"], axis=1).to_list() == [11, 22]
    assert f.assign({"w": [7, 8, 9], "k": 1, "d": F.col("v") * 2}).to_records()[1] == {"city": "b", "v": 12, "w": 8, "k": 1, "d": 24}
    assert f.filter([True, False, True]).shape == (2, 2) and f.filter(lambda r: r["city"] == "b").shape == (1, 2) and f.query("v > 5").shape == (1, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_rank(spark, seed):
    """Every method and option against a count in plain Python."""
    rng = random.Random(seed)
    values = [rng.choice([None, 1.5, 2, 7, 7.25, -3]) for _ in range(23)]
    f, real = Frame.create({"x": values}), [v for v in values if v is not None]

    def expected(v, at, method, up, na):
        if v is None:
            return {"keep": None, "top": 1.0, "bottom": len(real) + 1.0}[na]
        less = sum((w < v) if up else (w > v) for w in real)
        same = real.count(v)
        own = {"min": less + 1, "max": less + same, "average": less + (same + 1) / 2, "dense": len({w for w in real if (w < v if up else w > v)}) + 1, "first": less + values[: at + 1].count(v)}[method]
        return float(own + (len(values) - len(real) if na == "top" else 0))

    for method, up, na in (("average", True, "keep"), ("min", False, "top"), ("max", True, "bottom"), ("dense", False, "keep"), ("first", True, "top"), ("first", False, "keep")):
        assert f.rank(method=method, ascending=up, na_option=na).get("x").to_list() == [expected(v, i, method, up, na) for i, v in enumerate(values)]
    share = f.rank(pct=True).get("x").to_list()
    assert share == [None if v is None else pytest.approx(expected(v, i, "average", True, "keep") / len(real)) for i, v in enumerate(values)]


def test_sample_and_describe(spark):
    f = Frame.create({"a": list(range(40)), "b": [i * i for i in range(40)]})
    x, y = f.sample(9, random_state=7), f.sample(9, random_state=7)
    assert x.values() == y.values() and f.sample(frac=0.25, random_state=1).shape == (10, 2) and x.labels() == [r[0] for r in x.values()]
    assert len({r[0] for r in x.values()}) == 9 and f.sample(60, replace=True, random_state=3).shape == (60, 2)
    with pytest.raises(ValueError):
        f.sample(41)
    assert [r["stat"] for r in f.describe().to_records()] == ["count", "mean", "std", "min", "max"]


def test_labels_stay(spark):
    """Labels of frames without own ones are first positions, through any chain of operations that keeps rows."""
    f = Frame.create({"v": [5, 9, 1, 7, 1, 3], "t": list("abcabc")})
    assert f.filter("v > 2").labels() == [0, 1, 3, 5] and f.sort_values("v").labels() == [2, 4, 5, 0, 3, 1]
    assert f.sort_values("v").filter(F.col("t") != "c").head(3).labels() == [4, 0, 3]
    assert f.filter("v > 2").loc(3) == {"v": 7, "t": "a"} and f.filter("v > 2").at(2, "v") is None
    assert f.drop_duplicates("t", keep="last").labels() == [3, 4, 5] and f.drop_duplicates("t", keep="last", ignore_index=True).labels() == [0, 1, 2]
    assert f.tail(2).reset_index().get("index").to_list() == [4, 5] and f.iloc([3, 0]).labels() == [3, 0]
    assert fw.concat([f.head(2), f.tail(1)]).labels() == [0, 1, 5] and fw.concat([f.head(2), f.tail(1)], ignore_index=True).labels() == [0, 1, 2]
    assert fw.concat([f.set_index("v").head(2), f.head(1)]).labels() == [5, 9, 0] and fw.concat([]).shape == (0, 0)
    g = fw.concat([f.head(2).set_index("t", drop=False), f.head(1).set_index("t", drop=False)], axis=1)
    assert g.labels() == ["a", "b"] and g.columns == ["v", "t", "v_1", "t_1"] and g.to_records()[1]["v_1"] is None


def test_callbacks(spark):
    """Functions get as many of their arguments as they want; errors in them aren't hidden."""
    f = Frame.create({"v": [4, 8, 6], "t": ["p", None, "q"]}, index=[30, 10, 20])
    assert f.filter(lambda row, label: label < 25).labels() == [10, 20] and f.query(lambda row, label, at: at != 1).labels() == [30, 20]
    assert f.applymap(lambda v, name: f"{name}={v}", returns="string").values()[1] == ["v=8.0", "t=None"]
    assert f.applymap(lambda v, name, label, at: label + at, returns="number").get("t").to_list() == [30, 11, 22]
    assert f.apply(lambda row, label, at: row["v"] + label + at, axis=1).to_dict() == {30: 34, 10: 19, 20: 28}
    assert f.select(["v"]).apply(lambda v, name, at: v.count() + at + len(name)).to_dict() == {"v": 4}
    s = f.get("v")
    assert s.map(lambda v, label: v * label).to_dict() == {30: 120, 10: 80, 20: 120} and s.filter(lambda v, label, at: at == 2).to_dict() == {20: 6}
    assert s.map(abs).to_list() == [4, 8, 6] and s.map(lambda c: c + 1, columnar=True).to_list() == [5, 9, 7]
    assert f.groupby("t", dropna=False, sort=False).agg({"v": lambda v, rows: len(rows.columns) + v.sum(), "t": "count"}).to_records() == [{"t": 1, "v": 6}, {"t": 0, "v": 10}, {"t": 1, "v": 8}]
    with pytest.raises(Exception, match="boom"):
        f.applymap(lambda v: (_ for _ in ()).throw(RuntimeError("boom"))).values()
    assert Frame.create({"m": [1, "x"], "n": [1, None], "o": [None, None]}).dtypes() == {"m": "mixed", "n": "number", "o": "unknown"}


def test_dense_positions(spark):
    """Dense in any order, over several partitions, and rows that a filter left."""
    sdf = spark.range(0, 1000, 1, 7).select(F.col("id"), F.pmod(F.col("id") * 37, F.lit(101)).alias("k"))
    f = Frame(sdf).filter("id % 3 = 0")
    assert [r["__ord"] for r in f._dense().sdf.orderBy("id").collect()] == list(range(334))
    g = f.sort_values(["k", "id"])
    want = sorted(((i * 37) % 101, i) for i in range(0, 1000, 3))
    assert [r["id"] for r in g._dense().sdf.orderBy("__ord").collect()] == [i for _, i in want] and g.iloc([5, -1]).get("id").to_list() == [want[5][1], want[-1][1]]


def test_sources(spark, tmp_path):
    f = fw.parse_csv("﻿id,city,t,ok\n1,Rome,2.5,true\n2,NA,,FALSE\n", index_col="id")
    assert f.labels() == [1, 2] and f.to_records() == [{"city": "Rome", "t": 2.5, "ok": True}, {"city": None, "t": None, "ok": False}]
    w = tmp_path / "w.csv"
    w.write_text('a,b,c\n1,"x\ny, z",2,3\n4,5\n')
    assert fw.read_csv(str(w)).to_records() == [{"a": 1, "b": "x\ny, z", "c": 2, "col_3": 3}, {"a": 4, "b": "5", "c": None, "col_3": None}] and fw.parse_csv(w.read_text()).to_records() == fw.read_csv(str(w)).to_records()
    j = tmp_path / "j.json"
    for text, lines in (('[{"z": 1, "a": {"k": null}}, {"b": "t"}]', False), ('{"z": 1, "a": {"k": null}}\n\n{"b": "t"}\n', True)):
        j.write_text(text)
        assert fw.read_json(str(j), lines=lines).to_records() == [{"z": 1, "a": '{"k":null}', "b": None}, {"z": None, "a": None, "b": "t"}]
    j.write_text('{"z": [1, 2], "a": ["x"]}')
    assert fw.read_json(str(j)).to_records() == [{"z": 1, "a": "x"}, {"z": 2, "a": None}]
    with pytest.raises(ValueError):
        fw.read_json(str(j), orient="records")
    p = tmp_path / "a.csv"
    p.write_text('a,b\n1,"x, y"\n2,"l1\nl2"\n3,z,extra\n')
    g = fw.read_csv(str(p))
    assert g.columns == ["a", "b", "col_2"] and g.get("b").to_list() == ["x, y", "l1\nl2", "z"] and g.get("col_2").to_list() == [None, None, "extra"]
    assert g.select(["a", "b"]).to_csv().startswith('a,b\n1,"x, y"\n')
    assert fw.parse_json('{"a":[1,2],"b":["x",{"k":1}]}').to_records()[1] == {"a": 2, "b": '{"k":1}'}
    assert fw.parse_json(g.to_json(lines=True), lines=True).shape == (3, 3)
    g.to_parquet(str(tmp_path / "p"))
    assert sorted(fw.read_parquet(str(tmp_path / "p"), columns=["a"]).get("a").to_list()) == [1, 2, 3]
    g.to_excel(str(tmp_path / "b.xlsx"), sheet_name="S")
    assert fw.read_excel(str(tmp_path / "b.xlsx"), sheet_name="S").get("b").to_list() == ["x, y", "l1\nl2", "z"]
    assert fw.parse_tsv("id\tv\n1\tx\n").to_records() == [{"id": 1, "v": "x"}]


def test_csv_folder(spark, tmp_path):
    """Each part has its header; rows follow the files' names, though Spark reads the largest first."""
    rows = [f"{i},{'abc'[i % 3] * (1 + 40 * (i > 20))}" for i in range(60)]
    for name, cut, last in (("a", 0, 10), ("b", 10, 45), ("c", 45, 60)):
        (tmp_path / f"{name}.csv").write_text("\n".join(["k,t", *rows[cut:last]]) + "\n")
    f = fw.read_csv(str(tmp_path))
    assert f.dtypes() == {"k": "number", "t": "string"} and f.get("k").to_list() == list(range(60))
    assert f.iloc([59, 10]).get("k").to_list() == [59, 10] and f.filter("k > 50").labels() == list(range(51, 60))
    texts = f.get("t").to_list()
    (tmp_path / "b.csv").write_text("\n".join([" ,", "k,t", *rows[10:45]]) + "\n")  # a blank row before the header
    (tmp_path / "c.csv").write_text("\n".join(rows[45:]) + "\n")  # no header: a row is no header unless it is the first file's
    (tmp_path / "d.csv").write_text("k,t\n")
    g = fw.read_csv(str(tmp_path))
    assert g.get("k").to_list() == list(range(60)) and g.get("t").to_list() == texts and fw.read_csv(str(tmp_path), header=False).shape == (63, 2)


def test_table_parts(spark, tmp_path):
    """Several parts that the engine wrote, with tabs."""
    Frame(spark.range(0, 40, 1, 4).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("t"))).to_csv(str(tmp_path / "p"), sep="\t", distributed=True)
    f = fw.read_table(str(tmp_path / "p"))
    assert f.to_records() == [{"id": i, "t": f"s{i % 3}"} for i in range(40)]
    g = fw.read_tsv(str(tmp_path / "p"), index_col="id")
    assert g.labels() == list(range(40)) and g.columns == ["t"] and g.loc(7) == {"t": "s1"}


@pytest.mark.parametrize("options", [{}, {"orient": "list"}, {"lines": True}])
def test_json_parts(spark, tmp_path, options):
    """Documents that the executors write, one a part, hold what one text holds; their rows keep their order."""
    sdf = spark.range(0, 40, 1, 4).select(F.col("id").alias('k "é'), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a,"]}\n['), F.col("id"))).alias("t"), (F.col("id") % 2 == 0).alias("b"))
    f, path = Frame(sdf), str(tmp_path / "p")
    f.to_json(path, distributed=True, **options)
    g = fw.read_json(path, lines=bool(options.get("lines")))
    assert g.columns == f.columns and g.to_records() == f.to_records() == fw.parse_json(f.to_json(**options), lines=bool(options.get("lines"))).to_records()
    assert g.filter(F.col("b")).labels() == list(range(0, 40, 2))
    if not options.get("lines"):
        f.filter("false").to_json(str(tmp_path / "none"), distributed=True, **options)
        assert fw.read_json(str(tmp_path / "none")).shape[0] == 0


def test_json_array_in_pieces(spark, tmp_path):
    """An array is cut into records a batch at a time; braces in texts and cut records don't matter, broken arrays raise."""
    rows = [{"k": i, "t": "}, {[" * (i % 4) + "é\\\"", "n": {"x": [i, {}]}} for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for k, part in enumerate((rows[:250], rows[250:260], [], rows[260:])):
            (tmp_path / f"{k}.json").write_text("\n" + json.dumps(part, indent=k or None), encoding="utf-8")
        f = fw.read_json(str(tmp_path))
        assert f.get("k").to_list() == list(range(300)) and f.get("t").to_list() == [r["t"] for r in rows] and f.get("n").to_list()[5] == '{"x":["5","{}"]}'
        for broken in ('[{"k": 1}', '[{"k": 1} {"k": 2}]', '[{"k": 1},]', '[{"k": 1}] x', '[3, {"k": 1}]'):
            (tmp_path / "3.json").write_text(broken)
            with pytest.raises(ValueError):
                fw.read_json(str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
