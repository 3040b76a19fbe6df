"""No label value is left out of language learning."""

from __future__ import annotations

from tidemark.llm import language


def test_rarer_languages_are_learned_too(spark):
    texts = {"a": "the cat and the dog were there", "b": "der Hund und die Katze sind nicht", "c": "\u043a\u043e\u0448\u043a\u0430 \u0438 \u0441\u043e\u0431\u0430\u043a\u0430"}
    many = {"a": 60, "b": 40, "c": 20}
    rows = [(i, texts[x], x) for i, x in enumerate(x for x, n in many.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.learn(docs)
    model = language.learn(docs, languages=2)
    assert model.names == ["a", "b", "c"] and (model.table == whole.table).all() and (model.uses == whole.uses).all()
    assert {x: model.label(t)[0] for x, t in texts.items()} == {x: x for x in texts}
