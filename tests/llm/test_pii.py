"""Operator 8 on secrets and on long tokens."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from tests.llm.test_operators import DOCS, prose, row

from tessera.llm import pii


def digest(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def kinds(spans):
    return sorted((pii.KINDS[s["kind"]], s["a"], s["b"]) for s in spans)


def test_secrets_by_form_and_what_stands_in_their_place(spark):
    rows = [row(i, f'{prose(i, 9)} token = "{digest(i)}" {prose(i + 500, 9)}') for i in range(40)]
    other = [f"XK-{k}7-{k * 31:04d}" for k in range(6)] + ["9" * 700 + "z", digest(77).upper()]
    rows += [row(100 + k, f'{prose(100 + k, 9)} token = "{x}"### {prose(600 + k, 9)}') for k, x in enumerate(other)]
    clean = [row(200 + k, f"{prose(200 + k, 9)} size = {k}42 {prose(700 + k, 9)} deadbeef 12345678") for k in range(8)]
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in pii.find_personal_data(spark.createDataFrame(rows + clean, DOCS)).collect()}
    text = {r[0]: r[1] for r in rows}
    for i in range(40):
        at = text[i].index(digest(i))
        assert kinds(got[i][1]) == [("secret", at, at + 40)] and got[i][0] == []
    for k, x in enumerate(other):
        at = text[100 + k].index(x)
        assert kinds(got[100 + k][1]) == [("id", at, at + len(x))]
    assert all(got[200 + k][1] == [] for k in range(8))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, DOCS)).collect()}
    assert '"[SECRET]"' in masked[3] and '"[ID]"###' in masked[106] and "999" not in masked[106]


def test_candidates_are_whole_tokens_in_linear_time():
    draw, text = random.Random(2), ""
    for _ in range(300):
        text += draw.choice(["a1b2c3", "(12345)", "x" * 300 + "7", "no", "1234", '"v1.2.3",', "é9é8é7", "'''12''34'''"]) + draw.choice([" ", "\n", "　"])
    want, at = [], 0
    for token in text.split():
        at = text.index(token, at)
        a = at + len(token) - len(token.lstrip(pii._EDGE))
        b = a + len(token.strip(pii._EDGE))
        if b - a >= 5 and any(c in "0123456789" for c in text[a:b]):
            want.append((pii.CANDIDATE, a, b))
        at += len(token)
    assert list(pii.candidates(text, [])) == want
    assert len(list(pii.candidates("7" * 2_000_000, []))) == 1


def test_contexts_take_whole_words_of_any_length():
    word = "w" * 1000
    far = f"{word}a {word} 123456 {word}b"
    near = f"{word}x {word} 123456 {word}b"
    (one, two, around), (one2, two2, around2) = (pii.contexts(t, [(t.index("123456"), t.index("123456") + 6)])[0] for t in (far, near))
    assert one == one2 and around == around2 and two != two2 and 0 not in (one, two, around)
    assert (pii.contexts("a b-123456 c", [(4, 10)]) == 0).all()


def plain_trust(found, texts):
    """Trusted values by plain loops over the graph of patterns and instances."""
    occurs = Counter()
    for text in texts:
        words = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
        occurs.update(k for k in pii.contexts(text, words).ravel().view("int64").tolist() if k)
    seeds, edges = set(), defaultdict(Counter)
    for row_ in found:
        for f in row_["found"]:
            if f["kind"] < pii.CANDIDATE:
                seeds.add(f["value"])
            for key in f["keys"]:
                if key:
                    edges[key][f["value"]] += 1
    edges = {k: v for k, v in edges.items() if len(v) >= pii.SUPPORT}
    trust, total, before, turn = dict.fromkeys(seeds, 1.0), {}, -1, 0
    while True:
        backed = {k: sum(n * trust.get(x, 0) for x, n in v.items()) for k, v in edges.items() if sum(trust.get(x, 0) >= pii.CONFIDENCE for x in v) >= pii.SUPPORT}
        new = [k for k in backed if k not in total]
        total |= {k: occurs[k] for k in new}
        spans = {k: sum(edges[k].values()) for k in backed}
        score = {k: min(1, w / max(total[k], spans[k])) for k, w in backed.items() if total[k] and spans[k] >= pii.CONFIDENCE * total[k]}
        trust = {x: max(score[k] for k in score if x in edges[k]) for x in {x for k in score for x in edges[k]} - seeds} | dict.fromkeys(seeds, 1.0)
        good = {x for x, t in trust.items() if t >= pii.CONFIDENCE}
        turn += 1
        if turn >= pii.ROUNDS and not new and len(good) == before:
            return good
        before = len(good)


def test_graph_scores_equal_plain_loops(spark, sf):
    rows = [row(k, f"{prose(k, 6)} contact {'at' if k % 3 else 'via'} user{k}@mail.org now {prose(k + 50, 6)}") for k in range(90)]
    rows += [row(100 + k, f"{prose(k, 6)} contact at KX-{k:05d} now {prose(k + 70, 6)} badge KX-{k:05d} issued") for k in range(8)]
    rows += [row(200 + k, f"{prose(k, 6)} badge NB{k:04d}7 issued {prose(k + 90, 6)} contact at home now size = {k}4242 done") for k in range(2)]
    docs = spark.createDataFrame(rows, DOCS).union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "0D", "''", "0L"))
    found = pii.extract(docs)
    want = plain_trust(found.collect(), [r["text"] or "" for r in docs.collect()])
    got = {r["value"] for r in pii.trusted_values(docs, found).collect()}
    assert got == want
    # planted instances: those beside the addresses, and through them those that only share a badge's pattern
    spans = {r["doc_id"]: kinds(r["spans"]) for r in pii.find_personal_data(docs).collect()}
    assert sum(len([s for s in spans[100 + k] if s[0] == "id"]) == 2 for k in range(8)) == 8
    assert sum(any(s[0] == "id" for s in spans[200 + k]) for k in range(2)) == 2
