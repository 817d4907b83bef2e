import math
import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import class_lm
from tessera.llm.words import chunked, utf8


def brute_force(docs, frequent):
    """Scores by dictionaries of words, with the fixed-size exchange and the gains of the module."""
    import pyarrow as pa

    texts = [["</>"] if not t else [*t.encode().lower().split(), "</>"] for _, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    shape = {"</>": class_lm.SHAPES}
    for w in {w for t in texts for w in t} - {"</>"}:
        _, kind, _ = class_lm.tokens(*next(chunked(utf8(pa.array([w.decode()]))))[2:])
        shape[w] = int(kind[0])
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    counts = Counter(w for t in train for w in t)
    kinds = {w: len(frequent) + s for w, s in shape.items()} | {w: k for k, w in enumerate(frequent)}
    types = len(frequent) + class_lm.SHAPES + 1
    table = np.zeros((types, types))
    for t in train:
        for a, b in zip(["</>", *t], t):
            table[kinds[a], kinds[b]] += 1
    start = class_lm.exchange(table, class_lm.CLASSES, class_lm.SWEEPS)
    hot = np.zeros((types, class_lm.CLASSES))
    hot[np.arange(types), start] = 1
    first = hot.T @ table @ hot
    cls = {w: int(start[kinds[w]]) for w in shape}
    near = {w: np.zeros((2, class_lm.CLASSES)) for w in counts}
    for t in train:
        for i, w in enumerate(t[:-1]):
            near[w][0][int(start[kinds[t[i - 1] if i else "</>"]])] += 1
            near[w][1][int(start[kinds[t[i + 1]]])] += 1
    for w in counts:
        if w != "</>" and w not in frequent:
            cls[w] = int(class_lm.gains(near[w][:1], near[w][1:], first).argmax())
    pairs, n_class = Counter(), Counter()
    for t in train:
        for a, b in zip(["</>", *t], t):
            pairs[cls[a], cls[b]] += 1
            n_class[cls[b]] += 1
    v_class, after = Counter(cls[w] for w in counts), Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    total = sum(n + 0.5 for n in (n_class[c] for c in range(class_lm.CLASSES)))
    share = lambda c: (n_class[c] + 0.5) / total
    step = lambda a, b: class_lm.BIGRAM * (pairs[a, b] / after[a] if after[a] else share(b)) + (1 - class_lm.BIGRAM) * share(b)
    word = lambda w: counts[w] - class_lm.DISCOUNT if counts[w] else class_lm.DISCOUNT * v_class[cls[w]] + 1
    scores = [sum(math.log10(step(cls[a], cls[b]) * word(b) / (n_class[cls[b]] + 1)) for a, b in zip(["</>", *t], t)) for t in texts]
    for a in range(class_lm.CLASSES):  # the words and an unseen one of each class, after any class
        mass = sum(step(a, cls[w]) * word(w) / (n_class[cls[w]] + 1) for w in counts)
        mass += sum(step(a, c) * (class_lm.DISCOUNT * v_class[c] + 1) / (n_class[c] + 1) for c in range(class_lm.CLASSES))
        assert abs(mass - 1) < 1e-9
    moved = sum(cls[w] != start[kinds[w]] for w in counts)
    return scores, held, moved


def test_scores_equal_brute_force_in_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT", 6)
    draw = random.Random(7)
    nouns, verbs = [f"noun{k}" for k in range(40)], [f"does{k}" for k in range(25)]
    docs = [(k, " ".join(f"the {draw.choice(nouns)} {draw.choice(verbs)} a {draw.choice(nouns)}" for _ in range(draw.randrange(1, 30)))) for k in range(120)]
    docs += [(500, None), (None, "The noun1 does1"), (501, ""), (7, docs[7][1]), (502, "the " * 700 + "never"), (503, "\t\x0b Ünï " * 3)]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, block int").repartition(3)
    counts = Counter(w for d, t in docs for w in (t or "").encode().lower().split() if d is None or zlib.crc32(str(d).encode()) % 7 != 2)
    frequent = None
    for size in (1 << 25, 300):
        found = {(r["doc_id"], r["n_tokens"]): r for r in class_lm.score_documents(rows, size).collect()}
        if frequent is None:
            import pyarrow as pa

            code = lambda w: int(class_lm.tokens(*next(chunked(utf8(pa.array([w.decode()]))))[2:])[0][0])
            ranked = sorted(counts, key=lambda w: (-counts[w], np.int64(np.uint64(code(w)).view(np.int64))))[:6]
            frequent = sorted(ranked, key=code)
            scores, held, moved = brute_force(docs, frequent)
            assert moved > 10
        assert sum(1 for _ in found) == len({(d, len((t or "").split()) + 1) for d, t in docs})
        for (d, t), score, out in zip(docs, scores, held, strict=True):
            r = found[d, len((t or "").encode().split()) + 1]
            assert r["held_out"] == out and abs(r["score"] - score) < 1e-6 * abs(score), (size, d)


def test_gains_order_classes_as_the_likelihood_does():
    draw = np.random.default_rng(3)
    table = draw.integers(50, 5000, (class_lm.CLASSES, class_lm.CLASSES)).astype(float)
    before, after = np.zeros((1, class_lm.CLASSES)), np.zeros((1, class_lm.CLASSES))
    before[0, [3, 9]], after[0, [5, 60]] = (2, 1), (1, 2)
    f = lambda x: (x * np.log(x)).sum()

    def likelihood(t):
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    exact = []
    for c in range(class_lm.CLASSES - 1):
        moved = table.copy()
        moved[:, c] += before[0]
        moved[c] += after[0]
        exact.append(likelihood(moved) - likelihood(table))
    found = class_lm.gains(before, after, table)[0]
    assert found[-1] == -np.inf and found[:-1].argmax() == int(np.argmax(exact))
    assert np.corrcoef(found[:-1], exact)[0, 1] > 0.999


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert class_lm.score_documents(empty).collect() == []
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = class_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r["train_tokens"], r["n_known"], r["n_tokens"]) for r in only] == [(0, 0, 3)] and only[0]["score"] < 0


def likelihood(table):
    """Of the class bigrams and of words given their classes, but for what no class changes."""
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_the_sweep_raises_the_likelihood_of_a_corpus(spark, sf, monkeypatch):
    tables, classes, transitions = [], class_lm._classes, class_lm._transitions

    def before(near, frequent, class_of, table):
        tables.append(np.asarray(table, float))
        return classes(near, frequent, class_of, table)

    def after(classed):
        tables.append(np.asarray(transitions(classed), float))
        return tables[-1]

    monkeypatch.setattr(class_lm, "_classes", before)
    monkeypatch.setattr(class_lm, "_transitions", after)
    class_lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).count()
    first, last = (t.reshape(class_lm.CLASSES, class_lm.CLASSES) for t in tables)
    assert likelihood(last) > likelihood(first) and first.sum() == last.sum()
