"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed from end to
end into the longest phrases that the automaton knows; phrases run across words. The
language whose phrases are fewest, each worth log2 of the training length in bits, wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import table

NOT_LETTERS = re.compile(r"[\W\d_]+")
OTHER_NUMBERS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
UNKNOWN = "und"


def letters(text: str | None) -> str:
    """The words of a text in lower case between single spaces; empty if it has no letter."""
    if not text:
        return ""
    low = NOT_LETTERS.sub(" ", text.lower())
    odd = {c for c in set(OTHER_NUMBERS.findall(low)) if not c.isalpha()}  # word characters such as fractions and superscripts
    for c in odd:
        low = low.replace(c, " ")
    words = low.split()
    return f" {' '.join(words)} " if words else ""


class SuffixAutomaton:
    """All substrings of a text, as a minimal automaton: a state is the table of its next states by letter."""

    def __init__(self, text: str):
        root: dict = {}
        states, link, length, at = [root], [-1], [0], 0
        number = {id(root): 0}
        for ch in text:
            cur = len(states)
            states.append({})
            number[id(states[cur])] = cur
            length.append(length[at] + 1)
            link.append(0)
            p = at
            while p >= 0 and ch not in states[p]:
                states[p][ch] = states[cur]
                p = link[p]
            if p >= 0:
                q = number[id(states[p][ch])]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(states)
                    states.append(dict(states[q]))
                    number[id(states[clone])] = clone
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and states[p].get(ch) is states[q]:
                        states[p][ch] = states[clone]
                        p = link[p]
                    link[q] = link[cur] = clone
            at = cur
        self.root = root
        self.states = states

    def phrases(self, text: str) -> int:
        """Pieces of the greedy parse into longest known substrings; an unknown letter is a piece of its own."""
        root, count = self.root, 0
        state: dict = {}
        for ch in text:
            to = state.get(ch)
            if to is None:
                count += 1
                to = root.get(ch)
                if to is None:
                    to = {}
            state = to
        return count


class Model:
    """Automata by language. ``samples``: (language, texts of letters), in a fixed order."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        self.langs = [lang for lang, _ in samples]
        whole = ["".join(texts) for _, texts in samples]
        self.automata = [SuffixAutomaton(t) for t in whole]
        self.bits = [math.log2(len(t) + 1) for t in whole]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score in 0..1 (how far the second is behind); ties go to the language that sorts first."""
        low = letters(text)
        if not low or not self.langs:
            return UNKNOWN, 0.0
        cost = sorted((a.phrases(low) * b, lang) for a, b, lang in zip(self.automata, self.bits, self.langs, strict=True))
        return cost[0][1], 1.0 if len(cost) < 2 else 1.0 - cost[0][0] / cost[1][0]


@lru_cache(maxsize=1)
def _model(samples: tuple) -> Model:
    return Model(samples)


def _batches(batches: Iterator[pa.RecordBatch], samples: tuple) -> Iterator[pa.RecordBatch]:
    model = _model(samples)
    for b in batches:
        got = [model.predict(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def held_out(id_col: str) -> F.Column:
    """One of three folds by the CRC of the id; a row without id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, docs_per_lang: int) -> tuple:
    """The bounded sample to learn from, of (text, lang): ``docs_per_lang`` whole texts of
    whatever length for each language, those first in hash order in as many buckets. The bound is on labelled rows alone."""
    h = F.xxhash64("text")
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = fit.groupBy("lang", F.pmod(h, F.lit(docs_per_lang)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "text"))["text"].alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: (r["lang"], r["bucket"])):
        low = letters(row["text"])
        if low:
            texts.setdefault(row["lang"], []).append(low)
    return tuple((lang, tuple(some)) for lang, some in sorted(texts.items()))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 32) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learned from text and language of rows that are not held out; id, language and
    other columns take no part in a prediction. ``und`` with score 0 where the
    text is null or has no letter, or nothing could be learned. Letters are those of all scripts, without numerals of any
    kind. At a tie the language that sorts first. A language with texts of any length is learned.
    Repeated rows come back as often; an empty table gives an empty one. Memory grows with the sampled
    texts: about half a kilobyte a letter in each worker."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    samples = training_sample(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"), docs_per_lang)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda it: _batches(it, samples), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
