"""Addresses and mixing on small fixtures."""

import itertools

import pytest

from paperloom.llm import addresses, mixing

SCHEMA = "address_id long, content string, street_address string, city string, state string, postal_code string, x string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, None, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(
    "text",
    ["55 Weaver Green Avenue, Flat 3, Dellathstead, EM, 10432", "Flat 3, Weaver Green Av. 55, Dellathstead, 10432-1234", "DELLATHSTEAD\nNo. 55, Weaver Grn Ave, Apt 3\n10432", "c/o Reception, 55 weaver green avenue, #3, dellathstead D-10432"],
)
def test_parse_is_one_form(text):
    p = addresses.parse_address(text)
    assert (p["house"], p["unit"], p["kind"], p["street"], p["city"], p["postal"]) == ("55", "3", "avenue", ["weaver", "green"], ["dellathstead"], "10432")


def test_pairs(spark):
    same = ["55 Weaver Green Avenue, Dellathstead, 10432", "Weaver Green Ave 55, Dellathstead", "55 Weaver Green Av, 10432", "55 Weaver Green Av, 10432"]
    other = ["57 Weaver Green Avenue, Dellathstead, 10432", "55 Weaver Green Street, Dellathstead, 10432", "55 Weaver Green Avenue, Flat 2, Dellathstead, 10432", "55 Weaver Green Avenue, Marelburg, 10999", "55 Heron Green Avenue, Dellathstead, 10432", None, ""]
    got = {tuple(r) for r in addresses.same_location_pairs(table(spark, same + other)).collect()}
    assert got == set(itertools.combinations(range(4), 2))
    assert addresses.same_location_pairs(table(spark, [None])).count() == 0


def test_misspelt_words_follow_the_corpus(spark):
    texts = [f"{i} Weaver Green Avenue, Dellathstead, 10432" for i in range(30)] + ["7 Waever Green Avenue, Delathstead"]
    got = {tuple(r) for r in addresses.same_location_pairs(table(spark, texts)).collect()}
    assert got == {(7, 30)}


def test_copies_do_not_make_a_misspelling_a_word(spark):
    texts = [f"{i} Falconside Street, Corarburg, 10225" for i in range(10)] + ["7 Falonside St, Corarburg 10225"] * 4
    got = {tuple(r) for r in addresses.same_location_pairs(table(spark, texts)).collect()}
    assert got == set(itertools.combinations([7, 10, 11, 12, 13], 2))
    texts = [f"{i} Hill Street, Corarburg, 10225" for i in range(30)] * 2 + [f"{i} Mill Street, Corarburg, 10225" for i in range(40, 45)]
    got = {tuple(r) for r in addresses.same_location_pairs(table(spark, texts)).collect()}
    assert got == {(i, i + 30) for i in range(30)}


def test_balance_meets_targets(spark):
    rows = [(i, "a" if i % 3 else "b", "word " * (1 + i % 17), "y") for i in range(600)] + [(900, None, "word", "y"), (901, "c", None, "y"), (902, "zz", "word", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string").drop("tokens")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(df, targets)
    out = mix.collect()
    assert {r.source for r in out} == {"a", "b"} and len(out) == 600
    assert all(0 <= r.copies <= (1 if r.source == "a" else 3) for r in out)
    report = {r.source: r for r in mixing.mix_report(mix, targets).collect()}
    assert report["b"].actual_share / report["a"].actual_share == pytest.approx(1.5, rel=0.02)
    assert report["none"].actual_share == 0 and report["none"].tokens == 0


def test_empty_mix(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(df, targets).count() == 0


@pytest.mark.parametrize("text,house,kind,street,city", [
    ("Hauptstraße 5, 10115 Berlin", "5", "strasse", ["haupt"], ["berlin"]), ("5 rue de la Paix, 75002 Paris", "5", "rue", ["de", "la", "paix"], ["paris"]),
    ("12 Oak Street, Springfield, Illinois 62704", "12", "street", ["oak"], ["springfield"]), ("12 Oak Street, Springfield, 62704", "12", "street", ["oak"], ["springfield"]),
])
def test_forms_of_other_countries_and_states(text, house, kind, street, city):
    p = addresses.parse_address(text, frozenset(["illinois"]))
    assert (p["house"], p["kind"], p["street"], p["city"]) == (house, kind, street, city)


def test_states_come_from_their_column(spark):
    rows = [(1, "12 Oak Street, Springfield, Illinois, 62704", "Illinois", "Springfield"), (2, "12 Oak Street, Springfield, 62704", None, "Springfield"), (3, "9 Elm Street, Illinois", "Illinois", None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "address_id long, content string, state string, city string").selectExpr("*", "content as street_address", "cast(null as string) as postal_code", "1 as a", "2 as k")
    assert [r.w for r in addresses.state_names(df).collect()] == ["illinois"]
    assert {tuple(r) for r in addresses.same_location_pairs(df).collect()} == {(1, 2)}


def test_blocks_of_a_large_location_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(addresses, "BLOCK", 3)
    df = table(spark, ["55 Weaver Green Avenue, Dellathstead, 10432"] * 13 + ["7 Heron Road, Marelburg, 10999"] * 2)
    assert {tuple(r) for r in addresses.same_location_pairs(df).collect()} == set(itertools.combinations(range(13), 2)) | {(13, 14)}
