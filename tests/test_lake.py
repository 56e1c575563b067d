"""Folders, text files, stored state, previews and growth."""

import json

import pytest
from pyspark.sql import functions as F

from loomlake.operators import compose as C
from loomlake.operators import curate, discovery, profile
from loomlake.plans.flow import Lake, refresh
from loomlake.plans.gold import GoldConfig, GoldRun, Growth, Member, Try, build_gold, display_name, lineage, replay, search, tries
from loomlake.plans.jobs import Jobs
from loomlake.plans.recipe import RecipeError, build, load, store
from loomlake.sources import lake as source


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("lake")
    shops = ["Shop Id,City.Name,Signup_At,Note`s"] + [f"{i},{'Köln' if i % 2 else 'Nice'},{i % 12 + 1}/{i % 28 + 1}/2024,\"line\nbreak {i}\"" for i in range(60)]
    (path / "shops.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(shops).encode())
    sales = ["city,amount"] + [f"{'Köln' if i % 3 else 'Nice'},{i}.5" for i in range(90)]
    (path / "sales.csv").write_bytes("\n".join(sales).encode("latin-1"))
    (path / "notes.txt").write_text("no table")
    return path


@pytest.fixture(scope="module")
def lake(spark, folder):
    return Lake.open(spark, str(folder))


def test_files_are_listed_read_and_typed(spark, folder, lake):
    assert lake.names() == ["sales", "shops"]
    shops, sales = lake.tables["shops"], lake.tables["sales"]
    assert dict(shops.dtypes) == {"shop_id": "bigint", "city.name": "string", "signup_at": "string", "note`s": "string"}
    first = shops.orderBy("shop_id").first()
    assert tuple(first) == (0, "Nice", "2024-01-01", "line\nbreak 0")
    assert sales.schema["amount"].dataType.simpleString() == "double" and sales.filter("city = 'Köln'").count() == 60
    assert source.text_shape(spark, str(folder / "sales.csv")) == ("ISO-8859-1", False) and source.text_shape(spark, str(folder / "shops.csv")) == ("UTF-8", True)
    assert lake.preview("shops", ["shop_id"], 10, 5).count() == 5 and lake.preview("sales", ["city"], 0, 9_999, raw=True).count() == 90
    assert source.preprocess(spark.createDataFrame([(None,)], "a string")).first()[0] is None
    with pytest.raises(ValueError):
        source.clean_names(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_profiles(lake):
    held = {(r.dataset, r["column"]): r for r in lake.columns().collect()}
    assert held["shops", "city.name"].secondary_type == "categorical" and held["shops", "signup_at"].secondary_type == "date"
    assert held["shops", "shop_id"].secondary_type == "integer" and held["sales", "amount"].secondary_type == "float"
    assert held["shops", "city.name"].sample_values == ["Nice", "Köln"] and held["sales", "city"].null_pct == 0.0
    assert {r.dataset: r.size_bytes > 0 for r in lake.datasets().collect()} == {"sales": True, "shops": True}
    assert {r.relation for r in lake.catalogue()[1].collect()} == {"has_column"}
    with pytest.raises(ValueError):
        lake.candidates("shops", "nothing")


def test_types_of_odd_columns(spark):
    rows = [("true ", "0x", "[1, 2]", None, "1", "x" * 50, 1, 0, 1.5), ("FALSE", "no", "['a']", None, "0", "is this the one that was asked for by all of them or is it not", None, 1, None)] * 11
    rows = [(*r[:5], f"{r[5]} {i}", *r[6:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "b string, c string, l string, n string, z string, p string, i int, k int, f double")
    kinds = profile.classify(df)
    assert kinds["b"] == ("string", "boolean") and kinds["c"] == ("string", "categorical") and kinds["l"] == ("string", "array")
    assert kinds["n"] == ("string", "other") and kinds["k"] == ("numeric", "binary") and kinds["i"] == kinds["f"] == ("numeric", "float")
    prose = spark.createDataFrame([(f"this is the text number {i} of all the texts that we have here for the test",) for i in range(30)], "t string")
    assert profile.classify(prose)["t"] == ("string", "textual")
    blob = spark.createDataFrame([(f"data:image/png;base64,{i}",) for i in range(30)], "t string")
    assert profile.classify(blob)["t"] == ("string", "other")


def test_quantiles_are_exact(spark):
    import numpy as np

    random = np.random.default_rng(0)
    x, y = random.normal(size=30_000), random.integers(0, 7, 30_000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double").repartition(5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {r["column"]: r.q for r in profile.quantiles(df, ["x", "y", "z"], ps).collect()}
    assert np.allclose(found["x"], np.quantile(x, ps), atol=1e-12) and np.allclose(found["y"], np.quantile(y, ps)) and "z" not in found
    one = spark.createDataFrame([(5,)], "v int")
    assert profile.quantiles(one, ["v"], [0.25, 0.75]).first().q == [5.0, 5.0]


def test_stored_profiles_stay_fresh(spark, folder, tmp_path):
    import shutil

    own, store = tmp_path / "own", str(tmp_path / "store")
    shutil.copytree(folder, own)
    assert refresh(spark, str(own), store) == {"sales": "profiled", "shops": "profiled"}
    assert refresh(spark, str(own), store) == {"sales": "fresh", "shops": "fresh"}
    (own / "sales.csv").write_text("city,amount\nNice,1\n")
    (own / "shops.csv").rename(own / "shops.old")
    assert refresh(spark, str(own), store) == {"sales": "profiled", "shops": "pruned"}
    assert source.clear(spark, f"{store}/columns") == ["sales"] and source.stored_names(spark, f"{store}/types") == ["sales"]
    assert source.clear(spark, store) == ["catalogue", "columns", "datasets", "types"] and source.stored_names(spark, store) == []


def test_composites_and_previews(lake, spark, tmp_path):
    made = lake.star("shops", [("sales", "city", "city.name")])
    assert made.df.count() == 60 and made.protected == ("city.name",)
    seen = lake.join_preview(made, ["shop_id"], 0, 7)
    assert seen["page"].count() == 7 and seen["aggregated"] == ["sales"] and seen["protected"] == ["city.name"]
    assert seen["unused_keys"] == ["signup_at", "note`s"] and {c["dataset"] for c in seen["columns"]} == {"shops", "sales"}
    pairs, _, found = lake.curated(made)
    assert set(pairs.columns) == {"column_1", "column_2", "soundness"} and found
    out = str(tmp_path / "pairs.csv")
    source.write_csv(pairs, out)
    assert source.read_csv(spark, out).count() == pairs.count()
    chained = lake.chain("shops", [("shops", "sales", "city", "city.name", {"amount": "max"})])
    assert chained.df.agg({"amount": "max"}).first()[0] == 89.5
    run = lake.gold()
    assert {d for _, d in lineage(run)} <= {"shops", "sales"} and json.dumps(run.record())
    graph = json.loads(lake.catalogue_json())
    assert {n["kind"] for n in graph["nodes"]} >= {"dataset", "column"} and graph["score_bounds"] == [0.0, 1.0]
    whole = json.loads(lake.catalogue_json(run))
    assert whole["has_run"] and not graph["has_run"] and {e["relation"] for e in whole["edges"]} >= {"has_column"}
    assert set(run.by_base()) == {t.id.split("::")[0] for t in run.tables} and all(set(sum(t.by_source().values(), [])) == set(t.columns) for t in run.tables)
    rows = lake.rebuild(str(tmp_path / "catalogue"), run)
    assert rows["nodes"] == len(graph["nodes"]) and rows["usable_nodes"] <= rows["nodes"] and rows["governance"] > 0
    assert search(made.df, "`city.name`", "KÖL", 3).count() == 3
    with pytest.raises(KeyError):
        run.table("nothing")


def test_keys_are_checked(spark):
    left = C.base("a", spark.range(3).withColumnRenamed("id", "k"))
    twice = spark.createDataFrame([(0, 1.0), (0, 3.0), (None, 9.0), (2, 5.0)], "k long, v double")
    made = C.star(left, [C.Candidate("b", twice, "k", "k", unique=True)])
    assert sorted((r.k, r.v) for r in made.df.collect()) == [(0, 2.0), (1, None), (2, 5.0)]
    once = spark.createDataFrame([(0, 1.0), (2, 5.0)], "k long, v double")
    assert C.guarded(C.Candidate("b", once, "k", "k", unique=True)).unique and not C.guarded(C.Candidate("b", twice, "k", "k", unique=True)).unique
    with pytest.raises(C.ComposeError):
        C.star(left, [C.Candidate("b", once, "k", "k")], usable={("a", "k")})
    with pytest.raises(C.ComposeError):
        C.star(left, [C.Candidate("b", once, "k", "k", {"v": "most_common"})])


def test_growth_falls_back_to_a_fresh_copy(spark):
    def table(n, *columns):
        return spark.range(n).selectExpr("CAST(id % 10 AS STRING) AS k", *[f"id * {i + 2} AS {c}" for i, c in enumerate(columns)])

    tables = {"wide": table(20, "a1", "a2", "a3", "a4", "a5"), "small": table(10, "z"), "other": table(15, "b1", "b2")}
    row = lambda base, d, score: (base, "k", d, "k", score, 1.0)
    scores = spark.createDataFrame([row("wide", "small", 0.9), row("other", "small", 0.8)], "base_dataset string, base_column string, candidate_dataset string, candidate_column string, score double, candidate_uniqueness double")
    config = GoldConfig.ad_hoc(width=8, uniqueness=0.0)
    usable = {(n, c) for n, df in tables.items() for c in df.columns}
    by_base = {"wide": [r for r in scores.collect() if r.base_dataset == "wide"], "other": [r for r in scores.collect() if r.base_dataset == "other"]}
    growth = Growth(tables, config, lambda df, name: df)
    made = growth.grown({"wide": 20, "small": 10, "other": 15}, by_base)
    assert {n: sorted(c.made.datasets) for n, c in made.items()} == {"wide": ["small", "wide"], "other": ["other", "small"]}
    assert set(growth.members) == {Member("wide", "wide"), Member("small", "wide"), Member("other", "other"), Member("small", "other", home=False)}
    assert made["wide"].made.df.count() == 20 and made["other"].made.df.count() == 15
    wider = Growth(tables, GoldConfig.ad_hoc(uniqueness=0.0), lambda df, name: df).grown({"wide": 20, "small": 10, "other": 15}, by_base)
    assert {n: sorted(c.made.datasets) for n, c in wider.items()} == {"wide": ["other", "small", "wide"]} and wider["wide"].made.df.count() == 20
    run = build_gold(tables, scores, usable, {}, config)
    assert all(t.df.columns == t.columns and set(t.provenance) == set(t.columns) for t in run.tables)
    assert display_name(["b", "a", "d", "c"]) == "a+b+c and 1 more"


def test_declutter_parts(spark):
    df = spark.createDataFrame([(f"c{i}", f"n{i % 20}", f"m{i % 20}", "x" if i < 2 else None, i % 20) for i in range(100)], "code string, name string, again string, rare string, v int")
    made = C.base("t", df)
    usable, unique = {("t", c) for c in df.columns}, {("t", "code"): 1.0, ("t", "name"): 0.2}
    assert curate.redundant_groups(made, usable, {"name"}) == [("name", ["again", "name"])]
    assert curate.mostly_null(df) == ["rare"] and curate.unused_keys(made, unique) == ["code"]
    assert curate.declutter(made, usable, unique) == ["code", "name", "rare"]
    assert curate.declutter(made, usable, unique, keys=False, nulls=False) == ["name"]
    assert discovery.score_bounds() == (0.0, 1.0)


def test_what_is_tried_for_an_edge():
    members = [Member("a", "a"), Member("b", "a"), Member("c", "c"), Member("b", "c", home=False)]
    assert tries(members, "a", "b") == [] and tries(members, "c", "b") == []  # there already
    assert tries(members, "a", "d") == [Try(None, settles=True)]  # without a home
    assert tries(members, "c", "a") == [Try("a", settles=True)]  # gives the other composite its rows
    assert tries(members, "a", "c") == [Try("c", settles=True)]  # lives alone
    assert tries([*members, Member("e", "e")], "e", "b") == [Try("a", settles=True), Try(None, settles=False, stays=True)]


def skewed(spark):
    """6,000 rows, a third of them under one key, with nulls, ties, zeros and values far apart."""
    import random

    rnd = random.Random(2)
    number = lambda: rnd.choice([None, 0.0, -1.5, 2.25, 1e-9, 3e8, float(rnd.randrange(-50, 50)), rnd.random() * 100])
    key = lambda i: "hot" if i % 3 == 0 else f"k{i % 200}" if i % 17 else None
    rows = [(key(i), number(), rnd.randrange(-5, 400), rnd.choice([None, "a", "b", "c", str(rnd.randrange(300))]), rnd.choice([True, False, None])) for i in range(6_000)]
    return rows, spark.createDataFrame(rows, "k string, x double, y int, `t.t` string, b boolean").repartition(3)


def test_modes_and_medians_in_two_levels(spark):
    import statistics
    from collections import Counter

    rows, df = skewed(spark)
    candidate = C.Candidate("d", df, "k", "k", {"x": "median", "y": "median"})
    names = {"x": "x m", "y": "y", "t.t": "t.u", "b": "b"}
    two = {r[0]: tuple(r)[1:] for r in C.grouped(candidate, names, one_pass=0).collect()}
    one = {r[0]: tuple(r)[1:] for r in C.grouped(candidate, names, one_pass=1 << 60).collect()}
    assert two == one and None not in two
    held: dict = {}
    for k, *values in rows:
        if k is not None:
            for i, v in enumerate(values):
                held.setdefault((k, i), []).extend([] if v is None else [v])
    common = lambda vs: min(Counter(vs).items(), key=lambda x: (-x[1], x[0]))[0] if vs else None
    middle = lambda vs: statistics.median(vs) if vs else None
    for k, (x, y, t, b) in two.items():
        assert (x, y, t, b) == (middle(held[k, 0]), middle(held[k, 1]), common(held[k, 2]), common(held[k, 3])), k
    # no task of the last shuffle holds the hot key's rows: they are combined by value first
    assert C.medians(df, "k", {"m": "y"}).filter("__key = 'hot'").count() == 1
    left = C.base("a", spark.createDataFrame([("hot",), ("k1",), (None,)], "k string"))
    assert {r.k: r["y"] for r in C.star(left, [candidate]).df.collect()} == {"hot": two["hot"][1], "k1": two["k1"][1], None: None}


def test_dependence_by_codes_and_by_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    df = spark.range(4_000).select(pick(1, 5).alias("a"), pick(1, 5).cast("string").alias("a.same"), F.when(F.col("id") % 9 > 0, pick(2, 700)).alias("wide"), pick(3, 7).alias("c"), F.concat(F.lit("r"), "id").alias("key"))
    found = {}
    for dense, cells in ((1_024, 4 << 20), (1_024, 1), (100, 4 << 20), (0, 1)):
        monkeypatch.setattr(curate, "FEW", 0)
        monkeypatch.setattr(curate, "DENSE", dense)
        monkeypatch.setattr(curate, "CELLS", cells)
        monkeypatch.setattr(curate, "BLOCK", 2)
        found[dense, cells] = sorted(map(tuple, curate.dependence(df).collect()))
    assert len({tuple(v) for v in found.values()}) == 1
    score = {(a, b): s for a, b, s in found[0, 1]}
    assert len(score) == 10 and score["a", "a.same"] > 10 and score["a", "c"] < 4
    assert all(s == 0.0 for pair, s in score.items() if "key" in pair)
    assert curate.dependence(df.select("key", "a")).collect()[0].soundness == 0.0 and curate.dependence(df.select("a")).collect() == []
    assert {tuple(r) for r in curate.pair_bijection(df, ["a", "a.same", "c"]).collect()} == {("a", "a.same", 1.0)}


def test_groups_once_columns_are_gone():
    groups = [("code", ["code", "id", "name"]), ("x", ["x", "y"])]
    assert curate.restricted(groups, ["id", "name", "x", "z"]) == [("id", ["id", "name"])]
    assert curate.restricted(groups, ["id", "name", "x", "y"], {"name", "y"}) == [("name", ["id", "name"]), ("y", ["x", "y"])]
    assert curate.restricted(groups, []) == []


def test_chain_states(spark):
    t = lambda n, *cols: spark.range(4).selectExpr("CAST(id AS STRING) AS k", *[f"id * {n} AS {c}" for c in cols])
    one, two = C.Step(C.Candidate("b", t(2, "x"), "k", "k"), "a"), C.Step(C.Candidate("c", t(3, "y"), "y", "x"), "b")
    chain = C.Chain.of("a", t(1, "v"))
    longer = chain.then(one).then(C.Step(C.Candidate("c", t(3, "y"), "k", "k"), "a"))
    assert [len(s.df.columns) for s in longer.states] == [2, 3, 4] and len(chain.states) == 1
    assert longer.at(1).now.datasets == ["a", "b"] and longer.at(0).now is chain.now
    other = longer.at(1).then(C.Step(C.Candidate("d", t(5, "x"), "k", "k"), "a"))
    assert other.now.df.columns == ["k", "v", "x", "x__d"] and longer.now.df.columns == ["k", "v", "x", "y"]
    assert other.searchable({("a", "k"), ("d", "x"), ("e", "z")}) == [("k", "a", "k"), ("x__d", "d", "x")]
    for wrong in (lambda: chain.then(two), lambda: longer.at(3)):
        with pytest.raises(C.ComposeError):
            wrong()


def planted(spark):
    """Two tables that join, with columns that hang together: a run of either mode gives clusters."""
    sales = spark.range(600).selectExpr("concat('shop ', id % 40) AS shop", "CAST(id % 3 AS STRING) AS kind", "concat('type ', id % 3) AS sort", "(id % 3) * 10 + id % 2 AS price")
    shops = spark.range(40).selectExpr("concat('shop ', id) AS name", "concat('city ', id % 4) AS city", "concat('zip ', id % 4, '-', id % 8) AS zip", "id * 1.5 AS size")
    return {"sales": sales, "shops": shops}


def test_runs_are_stored_and_replayed(spark, tmp_path):
    tables = planted(spark)
    own = Lake(spark, tables)
    for mode in ("every_table", "ad_hoc"):
        run = own.gold(mode=mode)
        assert run.tables and any(t.cluster for t in run.tables) and not run.failed
        whole = json.loads(own.catalogue_json(run))
        assert {e["relation"] for e in whole["edges"]} >= {"has_column", "built_from", "derived_from", "joined_via"} and "joinable" not in {e["relation"] for e in whole["edges"]}
        run.save(spark, str(tmp_path / mode))
        again = GoldRun.load(spark, str(tmp_path / mode))
        assert json.dumps(again.record(), sort_keys=True) == json.dumps(run.record(), sort_keys=True)
        for t in run.tables:
            rows = sorted(map(tuple, t.df.collect()), key=repr)
            for anew in (False, True):
                made = replay(again.table(t.id), planted(spark), anew)
                assert made.columns == t.columns and sorted(map(tuple, made.collect()), key=repr) == rows
        big = next(t for t in again.tables if t.cluster and len(t.datasets) > 1)
        with pytest.raises(RecipeError):
            replay(big, {"sales": tables["sales"]})
        with pytest.raises(RecipeError):
            replay(big, tables | {"shops": tables["shops"].drop("city")})
        loose = {"sales": tables["sales"].selectExpr("shop", "CAST(rand(1) * 9 AS STRING) AS kind", "CAST(rand(2) * 9 AS STRING) AS sort", "rand(3) AS price"), "shops": tables["shops"].selectExpr("name", "'x' AS city", "'y' AS zip", "1.5 AS size")}
        with pytest.raises(RecipeError):
            replay(big, loose, anew=True)


def test_recipes_of_any_composition(spark, tmp_path):
    t = lambda n, key: spark.range(9).selectExpr(f"CAST(id % {n} AS STRING) AS {key}", "id AS v", "concat('w', id % 2) AS w")
    tables = {"a": t(9, "k"), "b": t(3, "k"), "c": t(2, "j"), "d": t(4, "i")}
    left = C.star(C.base("a", tables["a"]), [C.Candidate("b", tables["b"], "k", "k", {"v": "max"})])
    right = C.chain(C.base("c", tables["c"]), [C.Step(C.Candidate("d", tables["d"], "i", "j", {"v": "median"}), "c")])
    made = C.merge(left, "k", right, "j", {"v": "min"})
    store(spark, str(tmp_path), "recipes", {"made": made.recipe, "a": C.base("a", tables["a"]).recipe})
    held = load(spark, str(tmp_path), "recipes")
    again = build(held["made"], tables)
    assert (again.df.columns, again.provenance, again.originals, again.protected, again.recipe) == (made.df.columns, made.provenance, made.originals, made.protected, made.recipe)
    assert sorted(map(tuple, again.df.collect()), key=repr) == sorted(map(tuple, made.df.collect()), key=repr)
    assert build(held["a"], tables).df.columns == ["k", "v", "w"]


def test_a_failing_scorer_leaves_the_joined_table(spark, monkeypatch):
    from loomlake.plans import gold

    real = gold.curate

    def failing(composed, *more, **how):
        if "shops" in composed.datasets:
            raise RuntimeError("no score")
        return real(composed, *more, **how)

    monkeypatch.setattr(gold, "curate", failing)
    run = Lake(spark, planted(spark)).gold()
    (id, error), *_ = run.failed.items()
    assert error == "RuntimeError: no score" and all(t.kind == gold.UNCURATED and len(t.datasets) == 2 for t in run.tables if t.id in run.failed)
    assert run.table(id).df.count() == {"sales": 600, "shops": 40}[id] and "failed" in run.record()


@pytest.mark.parametrize("mode", ["every_table", "ad_hoc"])
def test_a_failure_is_no_result(spark, monkeypatch, mode):
    from pyspark.errors import PySparkException

    from loomlake.plans import gold, lake_queries

    monkeypatch.setattr(lake_queries, "lake", lambda *at: Lake(spark, planted(spark)))
    query = lake_queries.QUERIES[f"gold_{mode}"]
    assert {r.kind for r in query(spark, "").collect()} >= {"cluster"}

    def failing(error):
        def curate(*a, **how):
            raise error

        monkeypatch.setattr(gold, "curate", curate)

    failing(ValueError("no score"))
    with pytest.raises(gold.GoldError, match="no score"):
        query(spark, "")
    # a job that fails ends the run, also where a failing scorer would not
    failing(PySparkException("out of memory"))
    with pytest.raises(PySparkException):
        Lake(spark, planted(spark)).gold(mode=mode)


def test_only_changed_tables_are_profiled_again(spark, tmp_path, monkeypatch):
    from loomlake.plans import flow

    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for i in range(8):
        (folder / f"t{i}.csv").write_text("name,day_date,n\n" + "\n".join(f"x{j % (i + 2)},1/{j % 28 + 1}/2024,{j}" for j in range(30)))
    scans, tried = [], []
    profiled, decided = flow.profile.lake_profile, flow.source.decide
    monkeypatch.setattr(flow.profile, "lake_profile", lambda tables, *more: (scans.append(sorted(tables)), profiled(tables, *more))[1])
    monkeypatch.setattr(flow.source, "decide", lambda df, *more: (tried.append(1), decided(df, *more))[1])
    assert set(refresh(spark, str(folder), kept).values()) == {"profiled"}
    before = sorted(map(repr, Lake.open(spark, str(folder), store=kept).columns().collect()))
    assert scans == [[f"t{i}" for i in range(8)]] and len(tried) == 8
    (folder / "t3.csv").write_text("name,n\n" + "\n".join(f"y{j % 5},{j}.5" for j in range(40)))
    (folder / "t7.csv").unlink()
    done = refresh(spark, str(folder), kept)
    assert {n for n, d in done.items() if d == "profiled"} == {"t3"} and done["t7"] == "pruned" and scans[1:] == [["t3"]] and len(tried) == 9
    own = Lake.open(spark, str(folder), store=kept)
    after = sorted(map(repr, own.columns().collect()))
    assert own.tables["t0"].schema["day_date"].dataType.simpleString() == "string" and own.tables["t0"].first().day_date == "2024-01-01"
    assert own.tables["t3"].schema["n"].dataType.simpleString() == "double" and own.names() == [f"t{i}" for i in range(7)]
    assert [r for r in after if "'t3'" not in r] == [r for r in before if "'t3'" not in r and "'t7'" not in r] and len(scans) == 2
    plain = sorted(map(repr, Lake.open(spark, str(folder)).columns().collect()))
    assert after == plain
    names = {r.id for r in flow.catalogue_of(spark, f"{kept}/catalogue")["nodes"].collect()}
    assert "dataset::t3" in names and "dataset::t7" not in names
    # a snapshot that is not whole is not seen
    path = source.new_snapshot(spark, f"{kept}/catalogue")
    spark.range(1).write.parquet(f"{path}/nodes")
    assert flow.catalogue_of(spark, f"{kept}/catalogue")["nodes"].columns != ["id"] or {r.id for r in flow.catalogue_of(spark, f"{kept}/catalogue")["nodes"].collect()} == names


def test_jobs_are_watched_and_cancelled(spark):
    import time

    jobs = Jobs(spark)
    assert jobs.state("x").status == "idle"
    own = Lake(spark, planted(spark))
    seen = []
    jobs.start("every_table", lambda progress: own.gold(progress=lambda *p: (seen.append(p), progress(*p))))
    assert jobs.start("every_table", lambda progress: 1 / 0).status == "running"  # one at a time
    state = jobs.wait("every_table", 300)
    assert (state.status, state.done, state.total) == ("done", 2, 2) and [p[0] for p in seen] == ["sales", "shops"] and state.seconds > 0
    assert jobs.result("every_table").tables
    assert jobs.start("bad", lambda progress: 1 / 0) and jobs.wait("bad", 60).error.startswith("ZeroDivisionError")
    with pytest.raises(RuntimeError):
        jobs.result("bad")

    def slow(progress):
        progress("long", 0, 1)
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()

    jobs.start("slow", slow)
    for _ in range(100):
        if jobs.state("slow").stages:
            break
        time.sleep(0.2)
    assert jobs.state("slow").stages and jobs.state("slow").at == "long"
    assert jobs.cancel("slow").status == "cancelled" and jobs.wait("slow", 60).status == "cancelled" and not jobs._threads["slow"].is_alive()


def test_learned_scores_and_their_bounds(spark):
    own = Lake(spark, planted(spark) | {"visits": spark.range(900).selectExpr("concat('shop ', id % 40) AS place", "concat('v', id % 50) AS who", "id AS n")})
    pairs = own.labelled_pairs()
    counted = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}
    assert counted[1.0] > 20 and counted[0.0] > counted[1.0]
    metrics = [c[2:] for c in pairs.columns if c.startswith("d_")]
    assert metrics == [m for m in discovery.REGISTRY if m not in discovery.RULES["numerical"][1]]
    model = own.fit_scorer(trees=20)
    low, high = discovery.model_bounds(model)
    scores = own.join_scores(model).collect()
    assert low < high and all(low - 1e-6 <= r.score <= high + 1e-6 for r in scores)
    fitted = discovery.learned(model, pairs)
    mean = {r.label: r.s for r in fitted.groupBy("label").agg({"score": "mean"}).withColumnRenamed("avg(score)", "s").collect()}
    assert mean[1.0] > 0.6 and mean[0.0] < 0.2
    best = own.candidates("sales", "shop", model).first()
    assert (best.candidate_dataset, best.candidate_column) in {("shops", "name"), ("visits", "place")}
    assert sorted(map(tuple, own.join_scores(own.fit_scorer(trees=20)).collect())) == sorted(map(tuple, scores))
    numeric = own.column_distances("numeric")
    assert {f"d_{m}" for m in discovery.REGISTRY} <= set(numeric.columns)


def test_pairs_by_blocks_and_by_the_index_of_shared_entries(spark):
    names = lambda i: [f"v{i % 7}", f"w{i % 5}"] + (["yes"] if i % 3 == 0 else [])
    rows = [(f"t{i % 4}", f"c{i}", "string" if i % 6 else "numeric", float(i), 0.5, names(i), [f"S{i % 11}"], "a", None) for i in range(60)]
    rows += [("t0", "empty", "string", 0.0, 0.0, [], [], None, None), ("t1", "twice", "string", 2.0, 1.0, ["v1", "v1"], ["S1"], "v1", "v1")]
    kinds = "dataset string, column string, main_type string, cardinality double, uniqueness double, freq_word_containment array<string>, freq_word_soundex_containment array<string>, first_word string, last_word string"
    profiles = spark.createDataFrame(rows, kinds)
    whole = discovery.distances(discovery.pairs(profiles))
    expected = sorted(map(repr, whole.collect()))
    by_cells = discovery.pairs(profiles, blocks=3)
    assert sorted(by_cells.columns) == sorted(discovery.pairs(profiles).columns)
    assert sorted(map(repr, discovery.distances(by_cells).collect())) == expected
    met = sorted(map(repr, whole.filter("containment > 0 OR soundex > 0").collect()))
    assert 0 < len(met) < len(expected)
    for hot in (1, 4, 1_024):  # at 1 every entry is dealt in parts, at 4 the common ones
        assert sorted(map(repr, discovery.distances(discovery.related_pairs(profiles, hot)).collect())) == met
    one = profiles.filter("column = 'twice'")
    assert sorted(map(repr, discovery.distances(discovery.pairs(profiles, bases=one)).collect())) == sorted(map(repr, whole.filter("base_column = 'twice'").collect()))
    none = profiles.limit(0)
    assert discovery.related_pairs(none).count() == 0 and discovery.pairs(none, blocks=2).count() == 0
    scores = discovery.scored(whole)
    best = {}
    for r in sorted(scores.collect(), key=lambda r: (-r.score, r.candidate_column, r.base_column)):
        best.setdefault((r.base_dataset, r.candidate_dataset), (r.base_column, r.candidate_column, r.score))
    found = discovery.best_per_dataset(scores, 0.0, top=None).collect()
    assert {(r.base_dataset, r.candidate_dataset): (r.base_column, r.candidate_column, r.score) for r in found} == best


def test_files_without_quoted_line_breaks_are_split(spark, tmp_path):
    rows = [f'{i},"a ""quoted"", cell {i}",{"ü" * 40}' for i in range(4_000)]
    (tmp_path / "wide.csv").write_text("\ufeffId,Note,Long\n" + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = source.read_csv(spark, str(tmp_path / "wide.csv"))
        assert df.rdd.getNumPartitions() > 3 and df.columns == ["Id", "Note", "Long"]
        assert sorted((int(r.Id), r.Note) for r in df.collect()) == [(i, f'a "quoted", cell {i}') for i in range(4_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "empty.csv").write_text("Id,Note\n")
    assert source.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0


def test_equal_frequencies_have_no_skewness(spark):
    """Merged moments of equal frequencies can be off by a rounding, which read as a spread."""
    counts = spark.range(0, 90_000, 1, 7).select(F.lit("a").alias("column"), F.col("id").cast("string").alias("value"), F.lit(1).cast("long").alias("freq"))
    assert counts.agg(F.stddev_pop("freq")).first()[0] > 0
    found = profile.frequency(counts).first()
    assert (found.frequency_skewness, found.frequency_kurtosis) == (0.0, 0.0)


def test_values_are_counted_as_stored(spark):
    """Only distinct values become text: the cast stands above the counting, for each type of columns."""
    df = spark.createDataFrame([(1, 2, 1.5, "a"), (1, None, 1.5, None), (3, 2, 0.0, "a"), (3, 2, -0.0, "b")], "a int, b long, c double, d string")
    counts = profile.value_counts(df, first=True)
    found = {(r["column"], r.value): r.freq for r in counts.collect()}
    assert found == {("a", "1"): 2, ("a", "3"): 2, ("b", "2"): 3, ("b", None): 1, ("c", "1.5"): 2, ("c", "0.0"): 2, ("d", "a"): 2, ("d", "b"): 1, ("d", None): 1}
    first = {r["column"]: r.sample_values for r in profile.first_values(counts).collect()}
    assert first == {"a": ["1", "3"], "b": ["2"], "c": ["1.5", "0.0"], "d": ["a", "b"]}


def test_repeated_rows_are_sought_only_where_there_may_be_some(spark, monkeypatch):
    """A column of distinct values rules them out; elsewhere hashes do, and rows that only share a hash are told apart."""
    sought, found = [], profile.duplicate_rows
    monkeypatch.setattr(profile, "duplicate_rows", lambda df: (sought.append(df.columns), found(df))[1])
    one = spark.range(30).select("id", F.lit("x").alias("t"), (F.col("id") % 3).alias("m"))
    two = spark.range(30).select((F.col("id") % 2).alias("u"), (F.col("id") % 3).alias("m"))
    own = Lake(spark, {"one": one, "two": two})
    assert {r.dataset: r.duplicate_row_count for r in own.datasets().collect()} == {"one": 0, "two": 24}
    assert sought == [["u", "m"]]
    nulls = spark.createDataFrame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert tuple(found(nulls).first()) == (4, 1)
    assert tuple(found(nulls.limit(0)).first()) == (0, 0)


def test_bins_come_from_one_table_of_counts(spark):
    """Rows are read once for all that bins are decided by, and pairs with a column of some thousand values are counted by codes."""
    df = spark.range(6_000).select((F.col("id") % 3).alias("few"), F.col("id").alias("whole"), (F.col("id") * 0.5).cast("float").alias("f"), F.exp(F.col("id") / 500).alias("heavy"), F.lit(2.5).alias("one"))
    written = []
    bins = curate.binned(df, keep=lambda held, name: (written.append(name), source.kept(held, name))[1])
    assert written == ["numbers"]
    assert [bins.select(c).distinct().count() for c in bins.columns] == [3, 10, 10, 10, 1]
    assert {r["count"] for r in bins.groupBy("heavy").count().collect()} == {600}
    size = {"a": (2_500, 10**8), "b": (10, 10**8)}
    days = spark.range(5_000).select((F.col("id") % 2_500).cast("string").alias("a"), (F.col("id") % 10).cast("string").alias("b"))
    found = curate.cells(days, [("a", "b")], profile.value_counts(days), size)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {r.n for r in found.collect()} == {2} and found.count() == 2_500


def test_a_composite_is_scored_from_its_faces(spark, tmp_path):
    """The scores, drops and null shares are those of the joined rows, which are neither written nor counted: only the root's
    columns are, and what is a function of one of them is looked up by its values."""
    from dataclasses import replace

    from loomlake.plans import gold

    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    shops = spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 30).alias("k"), pick(1, 4).cast("string").alias("city"), (F.col("id") % 5 * 1.5).alias("x"), F.concat(F.lit("z"), pick(1, 4)).alias("zip"), F.when(F.col("id") < 2, "r").alias("rare"))
    cities = spark.range(8).select((F.col("id") % 6).cast("string").alias("c"), (F.col("id") * 7).alias("size"), F.concat(F.lit("n"), F.col("id") % 2).alias("land"))
    sales = spark.range(3_000).select(
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("shop"), F.when(F.col("id") % 7 > 0, F.col("id") % 6).cast("string").alias("place"), F.exp(F.col("id") % 900 / 90).alias("heavy"),
        (F.col("id") % 6).alias("few"), (pick(5, 100) / 7).cast("float").alias("f"), pick(6, 500).alias("n"), F.lit("a").alias("one"), F.col("id").alias("id"),
    )
    tables, keep = {"sales": sales, "shops": shops, "cities": cities}, lambda df, name: source.kept(df, name)
    shelf = gold.Shelf(tables, keep)
    chained = C.attach(C.base("sales", sales), C.Candidate("shops", shops, "k", "shop"), looked=shelf.looked("shops", "k"))
    chained = C.merge(chained, "city", C.base("cities", cities), "c", hold=lambda df: keep(df, "looked"))
    star = C.attach(C.attach(C.base("sales", sales), C.Candidate("shops", shops, "k", "shop"), looked=shelf.looked("shops", "k")), C.Candidate("cities", cities, "c", "place"))
    usable = {(d, c) for d, df in tables.items() for c in df.columns}
    for made in (chained, star, C.base("sales", sales)):
        held = shelf.faces(made)
        assert len(held.parts) == 1 + len({made.determinants()[x.on] for x in made.lookups})
        assert curate.redundant_groups(made, usable, faces=held) == curate.redundant_groups(made, usable)
        assert curate.mostly_null(made.df, faces=held) == curate.mostly_null(made.df)
        lean = replace(made, df=made.df.drop("one"))
        one, _, groups = curate.curate(lean, keep=keep, faces=held)
        two, _, same = curate.curate(lean)
        scores = [{(r.column_1, r.column_2): round(r.soundness, 4) for r in x.collect()} for x in (one, two)]
        assert scores[0] == scores[1] and len(scores[0]) > 10 and max(scores[0].values()) > 4
        assert {k: v.columns for k, v in groups.items()} == {k: v.columns for k, v in same.items()}
    scan = curate._cells_of(shelf.faces(star), sorted(star.df.columns), ["few", "heavy", "city", "land", "size"], dict.fromkeys(star.df.columns, (5, 3_000)), keep)
    assert scan.select("pair").distinct().count() == 10
    # whether rows meet is told by the values of the two columns
    rate = C.match_rate(C.merge(C.base("sales", sales), "shop", C.base("shops", shops), "k"), ["k"]).first()[0]
    assert 0 < rate < 1 and abs(shelf.match(C.base("sales", sales), "shop", C.base("shops", shops), "k") - rate) < 1e-12
    assert shelf.match(C.base("sales", sales.limit(0)), "shop", C.base("shops", shops), "k") == rate  # the shelf's table of that name


def test_no_composite_is_written(spark, monkeypatch):
    """Steps that wrote or recounted the joined rows, which took most of a run's time."""
    written = {}
    kept = source.kept
    monkeypatch.setattr(source, "kept", lambda df, name: (out := kept(df, name), written.setdefault(name, []).append(out.count()))[0])
    for mode in ("every_table", "ad_hoc"):
        own = Lake(spark, planted(spark))
        assert own.gold(mode=mode).tables
        # the larger table has 600 rows, and its columns 40, 3, 3 and 6 values
        assert not {n for n in written if n in ("binned", "composite") or n.startswith("joined-")} and max(written["face"]) <= 40
