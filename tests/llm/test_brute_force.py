"""Operators 1, 7 and 10 against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import DOCS, EDGE, prose, row

from tessera.llm import decontam, langid, sharding


def smith_waterman(item, text):
    above, best = [0] * (len(text) + 1), 0
    for a in item:
        now = [0]
        for j, b in enumerate(text):
            now.append(max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, now[j] - 1))
        best, above = max(best, *now), now
    return best


def test_alignments_equal_plain_smith_waterman(spark):
    draw, items, docs = random.Random(4), {}, []
    for k in range(12):
        items[k] = prose(100 + k, 12 + k).split()
    items[12] = items[3]  # equal items both match
    for k in range(90):
        words = list(items[k % 12])
        for _ in range(k % 9):  # edits of each kind
            at = draw.randrange(len(words))
            kind = draw.randrange(3)
            words[at : at + (kind > 0)] = [["added"], ["other"], []][kind]
        docs.append((k, prose(k, k % 20).split() + words + prose(900 + k, 5 + k % 40).split()))
    docs += [(200, items[5] + items[5][:4] + items[6]), (200, items[5] + items[5][:4] + items[6]), (201, items[7][:2]), (None, items[8])]
    want = Counter()
    for doc, words in docs:
        for i, item in items.items():
            score = smith_waterman(item, words)
            if score >= decontam.SCORE * len(item):
                want[doc, i, round(score / len(item), 9)] += 1
    frame = spark.createDataFrame([(d, " ".join(w), "c", 1) for d, w in docs] + [(300, None, "c", 1), (301, "", "c", 1)], "doc_id long, text string, code string, item_id int")
    benchmark = spark.createDataFrame([(i, " ".join(w).upper(), "t") for i, w in items.items()] + [(40, None, "t"), (41, "", "t"), (None, " ".join(items[0]), "t")], "item_id long, text string, found string")
    rows = decontam.contaminated(frame.repartition(4), benchmark).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rows) == want and len(want) > 60
    left = decontam.drop_contaminated(frame, benchmark)
    bad = {d for d, *_ in want}
    assert left.columns == frame.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in docs + [(300, 0), (301, 0)] if d not in bad)


def profile(text):
    """A text's vector, letter by letter."""
    symbols = [0]
    for c in text:
        low = c.lower()[0] if c.isalpha() else ""
        code = ord(low) if low else 0
        if code or symbols[-1]:
            symbols.append(code)
    symbols += [0] if symbols[-1] else []
    vector = lambda code: np.random.default_rng([langid.SEED, code]).integers(0, 2, langid.DIMENSIONS, dtype=np.int8) * 2 - 1
    known = {c: vector(c).astype(int) for c in set(symbols)}
    out = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            out += np.roll(known[a], 2) * np.roll(known[b], 1) * known[c]
    return out


def test_profiles_equal_plain_vectors(spark):
    texts = ["Der schnelle braune Fuchs.", "the quick brown fox!", "Größe, Übung; Straße?", "a", "A b.", "x1y2z3...", "12 34", "", None, "the end.", "\u0646\u0635 \u0639\u0631\u0628\u064a", "the the the", "oh no -- the dog", "und der Hund"]
    docs = [(k, t, "de" if t and k % 3 == 0 else "en" if k % 5 else None, "s") for k, t in enumerate(texts)] + [(3, "the thing", "en", "s"), (3, "the thing", "en", "s"), (None, "kein Ding", "de", "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(2)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    letters = lambda t: any(c.isalpha() for c in t or "")
    table = {}
    for d, t, lang, _ in docs:
        if lang and letters(t) and not held(d):
            table[lang] = table.get(lang, 0) + unit(profile(t))
    names = sorted(table)
    want = []
    for d, t, *_ in docs:
        scores = [float(unit(profile(t)) @ unit(table[n])) for n in names] if letters(t) else []
        want.append((str(d), held(d), names[int(np.argmax(scores))] if scores else "und", round(max(0.0, max(scores, default=0.0)), 5)))
    got = [(str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 5)) for r in langid.identify(frame).collect()]
    assert sorted(got) == sorted(want) and len(names) == 2


def test_ties_take_the_first_name(spark):
    docs = [(k, "same words here", lang, "s") for k, lang in ((0, "b"), (2, "a"), (3, "b"), (5, "a"))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    names, prototypes = langid.learn(frame)
    assert names == ["a", "b"] and {r["lang_pred"] for r in langid.predict(frame, names, prototypes).collect()} == {"a"}


@pytest.mark.parametrize("slice_rows", [7, 2000])
def test_shards_equal_one_sorted_list(spark, slice_rows):
    docs = [row(i, prose(i, i % 9), source=None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [row(i, t) for i, t in EDGE] + [row(5, "again"), row(5, "again")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit(1), "cut": F.lit("x"), "at": F.lit(2)})
    hashed = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.lit(sharding.SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h")).distinct().collect()}
    none = lambda x: (x is not None, x or 0)
    rows = [(hashed[d[0]], none(d[0]), zlib.crc32((d[1] or "").encode()), len((d[1] or "").encode()) + 1, d[3]) for d in docs]
    ranked = []
    for source in {r[4] for r in rows}:
        own = sorted(r for r in (x[:4] for x in rows if x[4] == source))
        ranked += [((2 * k + 1) / (2 * len(own)), (source is not None, source or ""), r) for k, r in enumerate(own)]
    ranked.sort()
    slices = max(1, min(65536, len(rows) // slice_rows))
    assert all(math.floor(a[0] * slices) <= math.floor(b[0] * slices) for a, b in zip(ranked, ranked[1:], strict=False))
    want, slots = [], Counter()
    for k, (_, (there, source), (_, (some, doc), crc, size)) in enumerate(ranked):
        shard = k * 16 // len(ranked)
        want.append((doc if some else None, size, crc, source if there else None, shard, slots[shard]))
        slots[shard] += 1
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["source"], r["shard"], r["slot"]) for r in sharding.interleave(frame, slice_rows=slice_rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
