import os
from pathlib import Path

import pytest

from sheafline import runtime


def test_the_session_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert runtime.shared_dir(spark) == named and runtime.stage_path(spark, "x").startswith(named)
    kept = runtime.cut(spark.range(5))
    assert kept.count() == 5 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert runtime.stage(spark.range(3).selectExpr("id", "array(id) as a"), "t").count() == 3
    assert any(p.name.startswith("sheafline-t-") for p in Path(named.removeprefix("file:")).iterdir())


def test_nothing_is_checkpointed_locally():
    package = Path(runtime.__file__).parent
    assert not [p for p in package.rglob("*.py") if "localCheckpoint(" in p.read_text()]


def test_the_core_does_not_import_the_llm_subpackage():
    package = Path(runtime.__file__).parent
    core = [p for p in package.rglob("*.py") if "llm" not in p.parts]
    assert core and not [p for p in core if ".llm" in p.read_text()]


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(spark, bound, how):
    left = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then id else null end as k", "id as row")
    right = runtime.cut(spark.range(0, 2000).selectExpr("id as key", "id * 2 as v"))
    out = runtime.lookup_join(left, right, "k", "key", how, bound)
    rows = out.collect()
    want = {i: (14 if i % 3 == 0 else 2 * i if i % 3 == 1 and i < 2000 else None) for i in range(3000)}
    if how == "inner":
        want = {i: v for i, v in want.items() if v is not None}
    assert {r["row"]: r["v"] for r in rows} == want and len(rows) == len(want)
    assert out.columns == ["k", "row", "key", "v"]


def test_release_deletes_what_was_staged(spark):
    df = runtime.stage(spark.range(5).toDF("a"), "once")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    runtime.release(spark)
    assert not os.path.exists(path)
    runtime.release(spark)
