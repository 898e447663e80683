"""Terms (p3), token ids (p8), leaks (p9), garbled texts (p10)."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlake.llm import p3_terms, p8_tokens, p9_leaks, p10_garbled
from weftlake.llm.prose import lines

DOCS = "doc_id bigint, text string, item_id int, lang string, ids string, n int"
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(p8_tokens.TOKENIZERS), reason="no vocabularies")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], DOCS)


def index(spark, rows):
    return spark.createDataFrame([(t, u, 1, "u", 2.0) for t, u in rows], "token string, urls array<string>, df int, url string, weight double")


def test_terms(spark):
    rows = [("a", ["u", "v"]), (" A", ["u", "u", None]), ("b", ["v", "w"]), ("B ", ["x"]), (None, ["u"]), (" ", ["u"]), ("c", None), ("c", []), ("solo", ["w"])]
    best = p3_terms.telling_terms(index(spark, rows)).collect()
    found = {(r.url, r.token) for r in best}
    assert {(r.url, r.tf, r.df) for r in best} == {("u", 3, 2), ("v", 1, 2), ("w", 1, 3), ("x", 1, 3)}
    assert all(r.weight == pytest.approx(r.tf * (np.log(5 / (1 + r.df)) + 1)) for r in best)
    assert found == {("u", "a"), ("v", "a"), ("w", "b"), ("x", "b")}
    weights = {(r.url, r.token): r for r in p3_terms.term_weights(index(spark, rows)).collect()}
    assert weights["u", "a"].tf == 3 and weights["u", "a"].df == 2 and weights["u", "a"].weight == pytest.approx(1.0)
    assert sum(r.weight**2 for (u, _), r in weights.items() if u == "w") == pytest.approx(1.0)
    assert p3_terms.telling_terms(index(spark, [])).count() == 0 and p3_terms.term_weights(index(spark, [])).count() == 0
    assert p3_terms.telling_terms(index(spark, [("t", [f"u{i}" for i in range(13)])])).count() == 0


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{p8_tokens.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    return p8_tokens.vocabulary(), library


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab 'st\n\té日😀<|>")), max_size=80))
def test_ids_equal_merging(encoders, text):
    own, library = encoders
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(np.array(ids, int)) == text


@needs_vocabulary
def test_ids_of_runs(encoders):
    own, library = encoders
    for text in ("a" * 5000, "ab" * 3000, " " * 2000, "\n" * 999, "<|endoftext|>", "aaaaaaab" * 400, "é" * 1001, "0123456789" * 300):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_id_tables(spark):
    rows = [(1, "Hello <|endoftext|>"), (2, None), (3, ""), (None, "x"), (1, "Hello <|endoftext|>"), (4, "long text " * 300_000)]
    encoded = p8_tokens.token_ids(docs(spark, rows))
    found = encoded.collect()
    assert len(found) == 6 and [r.ids for r in found if r.doc_id in (2, 3)] == [[], []]
    assert sum(r.doc_id == 1 for r in found) == 2 and 50256 not in next(r.ids for r in found if r.doc_id == 1)
    back = {r.doc_id: r.text for r in p8_tokens.token_texts(encoded).collect()}
    assert back[1] == rows[0][1] and back[2] == "" and back[4] == rows[5][1] and back[None] == "x"
    assert p8_tokens.token_ids(docs(spark, [])).count() == 0


ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."


def leaks(spark, texts, items, **how):
    table = spark.createDataFrame([(i, t, 9, "z") for i, t in items], "item_id bigint, text string, doc_id int, word string")
    return sorted(tuple(r) for r in p9_leaks.leaks(docs(spark, texts), table, **how).collect())


def test_leaks(spark):
    words = ITEM.split()
    texts = [(1, f"before, {ITEM} after"), (2, " ".join(words[:12]).upper()), (3, " ".join(words[:11]) + " x " + " ".join(words[11:])), (4, None), (5, ""),
             (None, ITEM), (6, "*one*\xa0two-three_four; five six SEVEN eight\nnine ten eleven twelve"), (1, f"before, {ITEM} after"), (7, "y " * 200_000 + ITEM)]
    items = [(10, ITEM), (11, None), (12, "too short"), (13, ITEM), (None, ITEM), (14, "")]
    want = [(d, i) for d in (1, 2, 6, 7) for i in (10, 13)]
    assert leaks(spark, texts, items) == want
    assert leaks(spark, texts, []) == [] and leaks(spark, [], items) == []


def test_leaks_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(p9_leaks, "BROADCAST_ROWS", 0)
    assert leaks(spark, [(1, ITEM)], [(10, ITEM), (11, ITEM + " more"), (12, "else")]) == [(1, 10), (1, 11)]


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(p9_leaks, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(p9_leaks, "BITS_EACH", 1)
    hashes = spark.range(-200_000, 200_000).selectExpr("cast(pmod(id, 2) + 1 as int) as kind", "id * 7919 as hash")
    held = p9_leaks.filters(hashes, [1, 10, 10**9])
    for kind in (1, 2):
        own = np.array([i * 7919 for i in range(-200_000, 200_000) if i % 2 + 1 == kind], np.int64)
        assert held[kind].passes(own.view(np.uint64)).all()
    assert not held[0].held.any()


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(len(words)))
        words[at : at + (kind != 1)] = [str(rng.choice(VOCABULARY)) if rng.random() < 0.5 else "foreign"] if kind < 2 else []
    return words


VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("edits", [1, 2])
def test_leaks_with_edits(spark, edits):
    rng = np.random.default_rng(edits)
    items = [(i, " ".join(rng.choice(VOCABULARY, 12))) for i in range(300)]
    texts = [(i, " ".join(["before", *rng.choice(VOCABULARY, 5), *edited(rng, t.split(), edits), *rng.choice(VOCABULARY, 5)])) for i, t in items]
    true = {(d, i) for d, t in texts for i, own in items if near(own.split(), t.split(), edits)}
    found = leaks(spark, texts, items, edits=edits)
    assert set(found) <= true and {(i, i) for i, _ in items} <= true
    assert len(found) >= 0.95 * len(true)
    assert p9_leaks.edit_distance([1, 2, 3], [1, 3], 2) == 1 and p9_leaks.edit_distance([1, 2, 3], [4, 5, 6], 1) == 2


def near(own, text, edits):
    """Whether some window of the text is within the edits: by the distance's table with free ends."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(own, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return min(row) <= edits


@pytest.fixture(scope="module")
def hmm():
    return p10_garbled.Labeller(p10_garbled.CharacterModel([*lines()[0], *p10_garbled.CENTRAL]))


CLEAN = [
    "", "plain", "naïve café", "Ð and Ñ, Â and Ã are letters of their own", "SÃO ÂNGELO: AÇÃO, NÃO", "√2 ≈ 1.41 and ∂f/∂x ≤ Ω", "├── src\n└── main",
    "图书馆在河边 東京", "zero​width﻿", "Он спросил, хотят ли они выйти", "ПО СЛОВАМ БЕЗ УСПЕХА", "“quoted” — and…", "«Â»", "½ ² ٣ 🙂",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(hmm, text):
    assert hmm.labels(text) == []


RUSSIAN, GERMAN = "Почти всё, что мы знаем о её жизни, взято из писем", "Wir können später über schöne Häuser für Gäste reden"


def spoil(text, wrote, read):
    """The text written in one encoding and read in another; bytes that the latter lacks stand for themselves."""
    raw = text.encode(wrote)
    if read == "gbk":
        return raw.decode(read, "replace")
    return "".join(chr(b) if (c := bytes([b]).decode(read, "replace")) == "\ufffd" else c for b in raw)


@pytest.mark.parametrize("text, wrote, read", [(GERMAN, "utf-8", r) for r in p10_garbled.READERS if r not in ("koi8_r", "gbk")] + [
    (RUSSIAN, "utf-8", "cp1251"), (RUSSIAN, "utf-8", "latin-1"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "koi8_r", "cp1251"),
    ("it’s “so” — done…", "cp1252", "latin-1"), ("it’s “so” — done…", "utf-8", "latin-1"),
])
def test_garbled_texts(hmm, text, wrote, read):
    spoiled = spoil(text, wrote, read)
    spans = hmm.labels(spoiled)
    assert spans and hmm.restore(spoiled, spans) == text
    mixed = f"Some words before. {spoiled} And some after."
    assert hmm.restore(mixed, hmm.labels(mixed)) == f"Some words before. {text} And some after."


LATIN = " ".join(t for t, lang in zip(*lines()) if lang in ("de", "fr", "es", "pt") and not t.isascii())
CYRILLIC = " ".join(t for t, lang in zip(*lines()) if lang == "ru")
POLISH = " ".join(p10_garbled.CENTRAL[:5])
ORIGINALS = {"cp1251": CYRILLIC, "koi8_r": CYRILLIC, "cp866": CYRILLIC, "iso8859_5": CYRILLIC, "cp1250": POLISH, "iso8859_2": POLISH}


@pytest.mark.parametrize("wrote, read", [*(("utf_8", r) for r in p10_garbled.READERS), *p10_garbled.PAIRS])
def test_originals_of_every_pair(hmm, wrote, read):
    text = ORIGINALS.get(wrote, CYRILLIC if read == "koi8_r" else LATIN)
    text = text if read != "latin_1" else text.replace("'", "’").replace(" ", " – ", 9)
    text = text.encode(wrote, "ignore").decode(wrote)
    spoiled = spoil(text, wrote, read)
    restored = hmm.restore(spoiled, hmm.labels(spoiled))
    if "gbk" in read:  # bytes that begin no character of two bytes are lost
        assert sum(a != b for a, b in zip(restored.split(), text.split())) < sum(a != b for a, b in zip(spoiled.split(), text.split())) / 2
    else:
        wrong = sum(a != b for a, b in zip(restored, text)) / sum(a != b for a, b in zip(spoiled, text)) if len(restored) == len(text) else 1
        assert wrong <= 0.03


def test_spans_begin_and_end_within_runs(hmm):
    for before, after in (("Москва—", ""), ("«", "»"), ("", "—да"), ("“", "”")):
        spoiled = before + spoil(RUSSIAN, "utf-8", "cp1251") + after
        assert hmm.restore(spoiled, hmm.labels(spoiled)) == before + RUSSIAN + after
    assert hmm.names(hmm.labels(spoil(RUSSIAN, "iso8859_5", "cp1251"))) == ["iso8859_5>cp1251"]
    assert hmm.names(hmm.labels(spoil(GERMAN, "utf-8", "gbk"))) == ["utf_8>gbk"]


def test_unlikely_originals_are_left_alone(hmm):
    for name in ("cp866>cp1251", "koi8_r>cp1251", "cp1251>koi8_r"):
        label = [x.name for x in hmm.states].index(name) + 1
        assert hmm.states[label - 1].inverse("Привет") not in (None, "Привет")
        assert hmm.restore("Привет мир", [(0, 6, label)]) == "Привет мир"


def test_lost_and_twice(hmm):
    assert hmm.names(hmm.labels("f�r G�ste")) == ["lost"]
    twice = GERMAN.encode().decode("cp1252").encode().decode("cp1252")
    assert hmm.restore(twice, hmm.labels(twice)) == GERMAN


def test_garbled_table(spark):
    model = p10_garbled.CharacterModel(lines()[0])
    bad = "schÃ¶ne HÃ¤user"
    rows = [(1, bad), (2, None), (3, ""), (None, bad), (4, "schöne Häuser"), (1, bad), (5, "x" * 1_000_000 + " " + bad)]
    found = p10_garbled.garbled(docs(spark, rows), model).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 5] and found[0].restored == "schöne Häuser" and found[0].pairs == ["utf_8>cp1252"]
    assert p10_garbled.garbled(docs(spark, []), model).count() == 0
    assert p10_garbled.train(spark.createDataFrame([], "sample_id bigint, text string")).score("é", " ") < 0


def test_characters_of_all_samples(spark):
    texts = [None, "", *(f"Ab {chr(0x4E00 + i % 7)} é" for i in range(5_200)), "ΑΣ Ѐ日 \x00😀"]
    samples = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "sample_id int, text string, lang string").repartition(3)
    model = p10_garbled.train(samples)
    want = p10_garbled.CharacterModel([*filter(None, texts), "", *p10_garbled.CENTRAL * p10_garbled.CENTRAL_WEIGHT])
    assert model.one == want.one and model.two == want.two
    assert model.two[("ѐ", "日")] == 1.0 and "😀" in model.one
