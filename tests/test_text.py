import pytest
from pyspark.sql import functions as F

from deltaloom.functions import similarity, text


def value(spark, expression, **columns):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw,folded",
    [(None, ""), ("", ""), ("  a \t b  \r\n c ", "a b\nc"), ("x（1）　y", "x(1) y"), ("a​b", "ab"), ("\n\n", "")],
)
def test_fold_text(spark, raw, folded):
    assert value(spark, text.fold_text("t"), t=raw) == folded


@pytest.mark.parametrize("raw,folded", [("功能描述1", "功能描述"), ("State 12", "State 12"), ("Chapter2024", "Chapter2024"), (" A  B3 ", "A B"), (None, "")])
def test_fold_title(spark, raw, folded):
    assert value(spark, text.fold_title("t"), t=raw) == folded


@pytest.mark.parametrize(
    "raw,found",
    [("Update（D/R_SDD01_001_003）", "D/R_SDD01_001_003"), ("Machine (SDD-001-003)", "SDD-001-003"), ("Two (REQ_12_3) and (note)", "REQ_12_3"), ("None (draft)", None), ("", None), (None, None), ("Last (SDD-1-2) (SDD-3-4)", "SDD-3-4")],
)
def test_document_id(spark, raw, found):
    assert value(spark, text.document_id("t"), t=raw) == found


@pytest.mark.parametrize("style,level", [("Heading 1", 1), ("heading_2", 2), ("标题 3", 3), ("4级标题", 4), ("二级标题", 2), ("SDD_Heading_4", 4), ("609_4", 4), ("Normal", None), (None, None), ("第三级标题", 3)])
def test_heading_level(spark, style, level):
    assert value(spark, text.heading_level("t"), t=style) == level


@pytest.mark.parametrize("raw,item", [("a) first", "a"), ("ｂ）second", "b"), ("12. item", "12"), ("（3）third", "3"), ("plain", None), ("", None), ("abc) no", None)])
def test_item_id(spark, raw, item):
    assert value(spark, text.item_id("t"), t=raw) == item


def test_keys(spark):
    key = "Top > Part1 > Leaf（x）"
    assert value(spark, text.parent_key("k"), k=key) == "Top > Part"
    assert value(spark, text.leaf_title("k"), k=key) == "Leaf（x）"
    assert value(spark, text.parent_key("k"), k="Only") == ""
    assert value(spark, text.common_prefix("a"), a=["alpha_one", "alpha_two"]) == "alpha_"
    assert value(spark, text.identifier_tokens("k"), k="getHTTPValue_u8") == ["get", "http", "value", "u", "8"]
    assert value(spark, text.plain_path("k"), k="./a\\b.h") == "a/b.h"
    assert value(spark, text.plain_path("k"), k="../x.h") == "../x.h"
    assert value(spark, text.opening_balance("k"), k="f(a[1]) { }") is True
    assert value(spark, text.opening_balance("k"), k="f(a]") is False
    assert len(value(spark, text.head_tail("k", 20), k="x" * 50)) == 20
    assert value(spark, text.term_set("k"), k="状态机 go") == ["状态机", "go", "状态", "态机"]


def test_ratio_against_brute_force(spark):
    import difflib
    import random

    pick = random.Random(4)
    pairs = [("".join(pick.choices("abc ", k=pick.randint(0, 30))), "".join(pick.choices("abc ", k=pick.randint(0, 30)))) for _ in range(60)] + [("", ""), ("a", ""), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r"), similarity.length_bound(F.col("a"), F.col("b")).alias("most"))
    for row in df.collect():
        wanted = 1.0 if row.a == row.b else 0.0 if not row.a or not row.b else difflib.SequenceMatcher(None, row.a, row.b, autojunk=False).ratio()
        assert row.r == pytest.approx(wanted) and row.most >= row.r - 1e-12


def test_opcodes(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    ops = df.select(similarity.opcodes_udf("a", "b").alias("o")).first().o
    assert [(o.tag, o.i1, o.i2, o.j1, o.j2) for o in ops] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]


def test_matching_blocks_and_bounds(monkeypatch):
    import difflib
    import random

    from deltaloom.functions import similarity

    pick = random.Random(6)
    for small in (0, 40, 250_000):
        monkeypatch.setattr(similarity, "_SMALL", small)
        for _ in range(60):
            a, b = ("".join(pick.choices("abc \n中", k=pick.randint(0, 60))) for _ in range(2))
            wanted = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert similarity._ratio(a, b, False) == (1.0 if a == b else wanted.ratio())
            assert similarity.common_subsequence(a, b) >= similarity.matched(a, b) == sum(x.size for x in wanted.get_matching_blocks())
            exact = similarity._ratio(a, b, False)
            assert all(similarity._ratio(a, b, False, least) == exact for least in (0.1, 0.5, exact) if least <= exact)
