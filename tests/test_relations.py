import pytest
from pyspark.sql import functions as F

from papyrine.operators import graph
from papyrine.plans import relation_queries as rel
from papyrine.plans.definitions import rule_definitions


def test_classes_keep_every_pair(spark):
    links = spark.createDataFrame([("d", "x", f"f{i:02d}", i) for i in range(60)] + [("d", "y", "f00", 0), ("e", "x", "f00", None)], "document_id string, symbol string, formula_id string, ord int")
    got = graph.member_classes(links, ["document_id", "symbol"], "formula_id", "ord").collect()
    assert len(got) == 62 and sum(x.earlier for x in got) == 60 * 59 // 2
    assert {(x.place, x.n) for x in got if x.formula_id == "f59"} == {(60, 60)}


SAID = {
    "ru_where_dash": ("Где N — остаток энергии.", "N", "остаток энергии"),
    "ru_where_is": ("где x_1 является мерой", "x_1", "мерой"),
    "ru_denotes": ("α обозначает поток", "\\alpha", "поток"),
    "ru_named": ("T называется порогом", "T", "порогом"),
    "ru_defined_as": ("q определяется как сумма", "q", "сумма"),
    "ru_let": ("Пусть z есть корень", "z", "корень"),
    "ru_denote_by": ("через V обозначим объём", "V", "объём"),
    "ru_is": ("β – это шаг", "\\beta", "шаг"),
    "en_where_is": ("where w_{2} is the weight", "w_2", "the weight"),
    "en_denotes": ("N denotes " + "a long tail " * 10, "N", ("a long tail " * 10).strip()),
    "en_defined_as": ("q is defined as the sum", "q", "the sum"),
    "en_let_be": ("Let k be an index;", "k", "an index"),
    "en_represents": ("θ represents an angle", "\\theta", "an angle"),
    "en_denote_by": ("we denote by R the radius", "R", "the radius"),
}


@pytest.fixture(scope="module")
def defined(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in SAID.items()] + [("null", None), ("twice", "N denotes first. N denotes FIRST.")], "id string, t string")
    return {(x.id, x.rule, x.symbol, x.definition) for x in rule_definitions(df, ["id"], "t").collect()}


@pytest.mark.parametrize("rule", SAID)
def test_every_rule_of_the_survey(defined, rule):
    assert (rule, rule, *SAID[rule][1:]) in defined


def test_definitions_once(defined):
    assert {x for x in defined if x[0] in ("null", "twice")} == {("twice", "en_denotes", "N", "first")}


def test_missing_relations_come_out(spark, data):
    x = {r.relation: r.n for r in rel.QUERIES["rel_of_contexts"](spark, data).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert x["variable_defined_in_context"] > 0
    shared = rel.QUERIES["sem_shared_variable"](spark, data)
    pairs = shared.alias("a").join(shared.alias("b"), ["document_id", "symbol"]).where("a.place < b.place").count()
    assert shared.agg(F.sum("later")).head()[0] == pairs > 0
    assert 0 < shared.where("defines").agg(F.sum("later")).head()[0] < pairs
