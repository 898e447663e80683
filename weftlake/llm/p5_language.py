"""p5: the language of each text block of a page, with a confidence.

A byte convolutional network, trained on labelled samples when a query starts,
judges blocks, whatever part of the page they stand in: for p5_found those that
are a sentence or more, for p5_pages those with a letter, for p5_segments all.
A block's probabilities are those of its fixed-length windows put together; its
confidence is the highest of them.  Pages are judged one by one, the network
travels to the workers, nothing is shuffled.  A page's language is that of most
of its judged text; blocks in other languages make it mixed.

Rows with null ``crawl_id`` or null or empty page give no rows; nor do, in
p5_found, blocks of fewer than eight space-separated words or without an end of
sentence.  To p5_segments a block without a letter is one segment of no language
(null) and confidence 0.  Repeated rows come out as often as they stand in the
table; equal texts get equal answers.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from ..sources.tables import table
from .bytecnn import ByteCnn
from .pages import declared_language
from .prose import lines
from .scan import parsed, slices

#: Labelled samples that the network is trained on at most.
SAMPLE_ROWS = 5_000
#: Log-likelihood that a change of language between two sentences costs.
CHANGE = -6.0
#: Words that a block must have to be judged, and what it must end with.
WORDS, ENDS = 8, (".", "!", "?")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+")


_TRAINED: dict[str, ByteCnn] = {}


def train(samples: DataFrame) -> ByteCnn:
    """The network, trained on at most SAMPLE_ROWS rows of ``samples (sample_id, lang, text)``.

    The prose that comes with the package is added for the languages sampled.
    A network is kept as long as the driver runs, for the same samples.
    """
    rows = (
        samples.where("text is not null and lang is not null")
        .orderBy("sample_id")
        .select("lang", "text")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    own = xxhash.xxh3_128_hexdigest("\0".join(f"{r.lang}\0{r.text}" for r in rows))
    if own not in _TRAINED:
        classes = sorted({r.lang for r in rows})
        more = [(t, lang) for t, lang in zip(*lines()) if lang in classes]
        texts = [r.text for r in rows] + [t for t, _ in more]
        _TRAINED.clear()
        _TRAINED[own] = ByteCnn(classes).fit(texts, [r.lang for r in rows] + [lang for _, lang in more])
    return _TRAINED[own]


def has_letter(text: str) -> bool:
    """True for blocks that say anything."""
    return any(c.isalpha() for c in text)


def is_judged(text: str) -> bool:
    """True for blocks that are long enough and end as a sentence does."""
    return text.endswith(ENDS) and text.count(" ") + 1 >= WORDS


def block_languages(crawl: DataFrame, network: ByteCnn, judged: Callable[[str], bool] = is_judged) -> DataFrame:
    """``crawl_id, block_no, declared, lang, confidence, n_chars`` of each block that is to be judged."""
    spark = crawl.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(network)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        html, pages = parsed(batch)
        classes = np.array(held.value.classes, object)
        ids = batch.column("crawl_id").to_pylist()
        at: dict[str, int] = {}
        rows = []
        for i, (page, blocks) in enumerate(zip(html, pages)):
            own = [(n, b.text) for n, b in enumerate(blocks) if judged(b.text)]
            declared = declared_language(page) if own else ""
            rows += [(ids[i], n, declared, at.setdefault(t, len(at)), len(t)) for n, t in own]
        p = held.value.probabilities(list(at))
        text = np.array([r[3] for r in rows], int)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        sure = p.max(axis=1) if len(p) else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.string()),
                pa.array(classes[best[text]].tolist(), pa.string()),
                pa.array(sure[text].astype(np.float64), pa.float64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ],
            ["crawl_id", "block_no", "declared", "lang", "confidence", "n_chars"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "page"):
                yield work(part)

    rows = crawl.select("crawl_id", "page").where("crawl_id is not null and octet_length(page) > 0")
    return spread(rows).mapInArrow(
        run, "crawl_id bigint, block_no bigint, declared string, lang string, confidence double, n_chars bigint"
    )


def segments(logs: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """Segments ``(first, after last, class, confidence)`` of sentences with these log-probabilities and lengths.

    The best sequence of classes, where each change costs; a segment's
    confidence is the mean probability of its class, by length.  Where one class
    is likeliest in all sentences, no sequence is better than that class alone.
    """
    path = logs.argmax(axis=1).tolist()
    if path.count(path[0]) < len(path):
        best, back = logs[0], []
        for own in logs[1:]:
            came = np.where(best >= best.max() + CHANGE, np.arange(len(best)), best.argmax())
            back.append(came)
            best = own + np.maximum(best, best.max() + CHANGE)
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        path.reverse()
    out, start = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            own = np.exp(logs[start:i, path[start]])
            sure = own[0] if len(own) == 1 else np.average(own, weights=sizes[start:i])
            out.append((start, i, path[start], float(sure)))
            start = i
    return out


def language_segments(crawl: DataFrame, network: ByteCnn) -> DataFrame:
    """``crawl_id, block_no, start, end, lang, confidence``: stretches of one language, by characters of their block.

    The segments of every block cover it whole, however short it is.
    """
    spark = crawl.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(network)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, pages = parsed(batch)
        ids = batch.column("crawl_id").to_pylist()
        places = [(ids[i], n, b.text) for i, blocks in enumerate(pages) for n, b in enumerate(blocks)]
        ends = {t: [*(m.end() for m in _SENTENCE_END.finditer(t)), len(t)] for t in dict.fromkeys(t for *_, t in places) if has_letter(t)}
        cut = {t: [t[a:b] for a, b in zip([0, *e], e)] for t, e in ends.items()}
        at: dict[str, int] = {}
        for parts in cut.values():
            for part in parts:
                at.setdefault(part, len(at))
        logs = np.log(held.value.probabilities(list(at)) + 1e-9)
        found = {}
        for t, parts in cut.items():
            own = segments(logs[[at[p] for p in parts]], [len(p) for p in parts])
            found[t] = [(ends[t][a - 1] if a else 0, ends[t][b - 1], held.value.classes[k], sure) for a, b, k, sure in own]
        rows = [(i, n, *s) for i, n, t in places for s in found.get(t) or [(0, len(t), None, 0.0)]]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        names = ["crawl_id", "block_no", "start", "end", "lang", "confidence"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "page"):
                yield work(part)

    rows = crawl.select("crawl_id", "page").where("crawl_id is not null and octet_length(page) > 0")
    return spread(rows).mapInArrow(run, "crawl_id bigint, block_no bigint, start bigint, end bigint, lang string, confidence double")


def page_languages(blocks: DataFrame) -> DataFrame:
    """``crawl_id, declared, lang, confidence, mixed`` of each page that has judged blocks.

    ``confidence`` is the share of the language's confident characters in all.
    """
    by_lang = blocks.groupBy("crawl_id", "declared", "lang").agg(
        F.sum(F.col("confidence") * F.col("n_chars")).alias("w"), F.sum("n_chars").alias("n")
    )
    return by_lang.groupBy("crawl_id", "declared").agg(
        F.max_by("lang", F.struct("w", "lang")).alias("lang"),
        (F.max("w") / F.sum("n")).alias("confidence"),
        (F.count("lang") > 1).alias("mixed"),
    )


def mislabelled_blocks(crawl: DataFrame, network: ByteCnn) -> DataFrame:
    """Judged blocks not in the language their page declares: ``crawl_id, block_no, lang``."""
    return block_languages(crawl, network).where("lang <> declared").select("crawl_id", "block_no", "lang")


def p5_found(spark, sf):
    return mislabelled_blocks(table(spark, sf, "pt_crawl"), train(table(spark, sf, "lang_samples")))


def p5_pages(spark, sf):
    return page_languages(block_languages(table(spark, sf, "pt_crawl"), train(table(spark, sf, "lang_samples")), has_letter))


def p5_segments(spark, sf):
    return language_segments(table(spark, sf, "pt_crawl"), train(table(spark, sf, "lang_samples")))


QUERIES = {"p5_found": p5_found, "p5_pages": p5_pages, "p5_segments": p5_segments}
SQL: dict[str, str] = {}
