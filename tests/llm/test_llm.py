"""The operators on training text against plain Python on small, awkward inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.llm import leakage, packing, queries, subtitles, truncation

# --- packing -----------------------------------------------------------------------------------------------------


def check_assignment(rows, sizes, capacities):
    for budget, capacity in capacities.items():
        filled, pieces = {}, {}
        for r in rows:
            if r["budget_id"] == budget:
                filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
                pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        assert all(v <= capacity for v in filled.values())
        assert set(pieces) == {d for d, n in sizes.items() if n}
        for d, p in pieces.items():
            p.sort()
            assert [k for k, _, _ in p] == list(range(len(p))) and sum(n for _, _, n in p) == sizes[d]
            assert [s for _, s, _ in p] == [capacity * k for k in range(len(p))]
            assert len(p) == 1 if sizes[d] <= capacity else all(n == capacity for _, _, n in p[:-1])


def test_packing_keeps_all_tokens_and_splits_only_what_is_larger(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 7, 64, 65, 128, 300, rng.randrange(1, 200)]) for i in range(900)}
    counts = spark.createDataFrame([(d, n, "x") for d, n in sizes.items()] + [(None, 5, "x"), (2000, None, "x")], "doc_id bigint, n_tokens int, budget_id string")
    budgets = spark.createDataFrame([(1, "a", 64), (2, "b", 256), (2, "b", 256), (3, "none", None)], "budget_id int, label string, capacity_tokens int")
    for shard in (100, 20_000):
        rows = packing.packed(counts, budgets, "doc_id", shard).collect()
        check_assignment(rows, sizes, {1: 64, 2: 256})
    summary = {r["budget_id"]: r for r in packing.packing_summary(packing.packed(counts, budgets), budgets).collect()}
    assert summary[2]["n_tokens"] == sum(sizes.values()) and summary[2]["filled"] > 0.95
    assert packing.packed(counts.limit(0), budgets).count() == 0


def test_pack_takes_the_cheapest_container_with_room():
    sizes = np.array([5, 9, 5, 1, 10, 10])
    k = packing.pack(sizes, 10)
    assert np.bincount(k, sizes).max() <= 10 and len(set(k)) == 4
    one = packing.pack(np.array([], int), 10)
    assert len(one) == 0


def plain_assigned(sizes, capacity, share):
    """The same rule, looking at all containers for every piece."""
    used = max(1, -(-int(sizes.sum()) // capacity))
    room, cost, out, left = [capacity] * used, [0.0] * used, [0] * len(sizes), sizes.sum()
    for i in np.argsort(-sizes, kind="stable"):
        fits = [k for k in range(len(room)) if room[k] >= sizes[i]]
        if not fits:
            room.append(capacity)
            cost.append(0.0)
            fits = [len(room) - 1]
        k = min(fits, key=lambda k: (cost[k], k)) if left > (1 - share) * float(sizes.sum()) else min(fits, key=lambda k: (room[k], k))
        room[k] -= sizes[i]
        cost[k] += packing.attention_cost(sizes[i : i + 1])[0]
        out[i], left = k, left - sizes[i]
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_assignment_equals_the_plain_rule(share):
    rng = np.random.default_rng(5)
    for capacity in (20, 64, 300):
        sizes = np.minimum(rng.lognormal(3, 1, 200).astype(int) + 1, capacity - 1)
        assert packing.assigned(sizes, capacity, share).tolist() == plain_assigned(sizes, capacity, share)


def test_packing_wastes_little_more_than_best_fit():
    sizes = np.minimum(np.random.default_rng(2).lognormal(6.2, 0.8, 4_000).astype(int) + 1, 2047)
    by_cost, best, out = (len(set(k)) for k in (packing.assigned(sizes, 2048), packing.assigned(sizes, 2048, 0.0), packing.pack(sizes, 2048)))
    assert out <= best * (1 + packing.SLACK) < by_cost


def test_token_counts_are_of_whole_texts(spark):
    import os

    if not os.path.exists(queries.RANKS):
        pytest.skip("no tokenizer file")
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (None, "x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, "doc_id", "text", queries.RANKS).collect()}
    encoding = packing._encoding(queries.RANKS)
    assert got == {1: len(encoding.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(encoding.encode_ordinary(long))}


# --- leaked passages ---------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 80))) for _ in range(2))
        assert leakage.myers(a, b) == distance(a, b)


WORDS = [f"{a}{b}{c}" for a in ("ga", "mer", "to", "sil", "bra") for b in ("nu", "vek", "do", "pli") for c in ("ra", "st", "mon", "fe")]
FILLER = [f"{a}{b}" for a in ("xun", "qof", "zyb", "kwu") for b in ("ad", "ed", "ud")]


def cues(parts):
    return "\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{p}" for i, p in enumerate(parts, 1)) + "\n"


def test_leaks_are_runs_of_twelve_words_under_layout_and_damage(spark):
    rng = random.Random(3)
    item = {k: [rng.choice(WORDS) for _ in range(30)] for k in (1, 2)}
    item[3] = item[1][5:20] + [rng.choice(WORDS) for _ in range(10)]
    items = [(k, "Answer the question." + "\n" + " ".join(w)) for k, w in item.items()] + [(4, "too short"), (5, None), (None, " ".join(item[2]))]

    def fill(n):
        return [rng.choice(FILLER) for _ in range(n)]

    def damaged(words):
        return [w if i % 5 else w[:2] + "x" + w[3:] for i, w in enumerate(words)]

    texts = {
        10: cues([" ".join(fill(8)), " ".join(item[1][0:12]).upper() + "?", " ".join(fill(6))]),
        11: cues([" ".join(item[2][3:9]), "Free captions at www.some-site.test", "[door slams]", "- ANNA: " + " ".join(item[2][9:15])]),
        12: cues([" ".join(damaged(item[2][10:25]))]),
        13: cues([" ".join(item[2][0:11]), " ".join(fill(9))]),  # one word short
        14: cues([" ".join(item[2][6:12]), " ".join(item[2][0:6])]),  # another order
        15: cues([" ".join(item[2][0:7]), " ".join(item[2][3:7]), " ".join(item[2][7:14])]),  # a cue repeated
        16: cues([" ".join(item[1][6:19])]),  # shared by items 1 and 3
        17: cues(["Answer the question. " * 6]),
        18: "",
        19: None,
        20: "\n".join([" ".join(fill(40_000)), " ".join(item[1][15:30])]),
        21: "<i>" + " ".join(f"<b>{w}</b>" for w in item[2][2:16]) + "</i>",
    }
    divided = item[2][4:18]
    texts[23] = cues([" ".join(divided[:3]) + f" {divided[3][:3]}-\n{divided[3][3:]} " + " ".join(divided[4:])])
    texts[22] = texts[10]
    docs = spark.createDataFrame([*texts.items(), (None, texts[10])], "doc_id bigint, text string").withColumn("item_id", F.lit(99))
    evals = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(99))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs, evals).collect()}
    assert got == {(10, 1), (22, 1), (11, 2), (12, 2), (15, 2), (16, 1), (16, 3), (20, 1), (21, 2), (23, 2)}
    old, leakage.BLOCK = leakage.BLOCK, 2
    try:
        assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs, evals).collect()} == got
    finally:
        leakage.BLOCK = old
    assert leakage.leaked_passages(docs.limit(0), evals).count() == 0 and leakage.leaked_passages(docs, evals.limit(0)).count() == 0


def leaks(spark, texts, items):
    docs, evals = (spark.createDataFrame(list(x.items()), f"{n} bigint, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs, evals).collect()}


def test_damaged_words_are_compared_with_the_word_they_stand_beside(spark):
    rng = random.Random(5)
    own = rng.sample(WORDS, 14)
    own[4], own[8] = "silverton", "golden"
    other = [*rng.sample(WORDS, 12), "silvertxa", "holden"]
    # nearer to a word of another item; turned into a word of another item
    near, turned = [["silvertxx" if w == "silverton" else w for w in own[:12]], ["holden" if w == "golden" else w for w in own[:12]]]
    both = [{4: "silvertxx", 8: "holden", 1: own[1][:2] + "x" + own[1][3:]}.get(i, w) for i, w in enumerate(own[:12])]
    texts = {k: cues([" ".join(FILLER[:6]), " ".join(w), " ".join(FILLER[6:])]) for k, w in ((1, near), (2, turned), (3, both), (4, own[:11]))}
    assert leaks(spark, texts, {1: " ".join(own), 2: " ".join(other)}) == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize(
    ("cuts", "damaged", "between"),
    [((6,), (2, 9), 5), ((4, 8), (), 5), ((6,), (), 70), ((4, 8), (), 70), ((), (4, 5, 6, 7), 0), ((4, 8), (1, 5, 9), 5), ((1, 2), (5, 8, 11), 5)],
)
def test_every_exact_piece_leads_to_verification_whatever_cues_lie_between(spark, cuts, damaged, between):
    own = random.Random(7).sample(WORDS, 16)
    passage = [w[:2] + "x" + w[3:] if i in damaged else w for i, w in enumerate(own[:12])]
    parts = [passage[a:b] for a, b in zip((0, *cuts), (*cuts, 12), strict=True)]
    filler = [random.Random(9).choice(FILLER) for _ in range(between)]

    def text(parts):
        return cues([" ".join(FILLER[:4]), *[c for p in parts for c in (" ".join(p), " ".join(filler or FILLER[:3]))]])

    short = [parts[0][1:], *parts[1:]] if 0 not in damaged else parts
    assert leaks(spark, {1: text(parts), 2: text([p for p in short if p])}, {1: " ".join(own[:12])}) == {(1, 1)}


def test_the_column_of_distances_equals_the_table():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 13))] for _ in range(2))
        plus, minus, full = np.array([(1 << len(a)) - 1]), np.array([0]), (1 << len(a)) - 1
        for x in b:
            plus, minus = leakage.advanced(np.array([sum(1 << i for i, y in enumerate(a) if x == y)]), plus, minus, full)
        for k in range(len(a) + 1):
            rows = (1 << k) - 1
            assert len(b) + int(plus[0] & rows).bit_count() - int(minus[0] & rows).bit_count() == distance(a[:k], b)


def test_divided_and_joined_words_are_borne_and_left_out_words_are_not(spark):
    own = random.Random(21).sample(WORDS, 14)
    divided = [*own[:5], own[5][:3] + "q", "z" + own[5][3:], *own[6:12]]
    joined = [*own[:5], own[5] + own[6], *own[7:12]]
    shifted_early = [own[0], own[1] + "x" + own[2], *own[3:12]]  # no exact piece beyond the shift
    left_out = [*own[:6], *own[8:12]]
    added = [*own[:4], *own[9:11], *own[4:10]]
    other_words = [*own[:7], *FILLER[:2], *own[9:11]]  # two of eleven lost
    texts = {k: cues([" ".join(FILLER[:5]), " ".join(w), " ".join(FILLER[5:])]) for k, w in enumerate((divided, joined, shifted_early, left_out, added, other_words), 1)}
    assert leaks(spark, texts, {1: " ".join(own)}) == {(1, 1), (2, 1)}


def test_misread_encodings_are_repaired():
    text = "première scène à côté"
    once = text.encode("utf-8").decode("latin-1")
    assert subtitles.repaired(once) == text
    assert subtitles.repaired(once.encode("utf-8").decode("latin-1")) == text
    assert subtitles.repaired(text) == text


# --- truncated texts ---------------------------------------------------------------------------------------------

END = "00:00:01,000 --> 00:00:02,000\n"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"1\n{END}All is well.\n", "whole"),
        (f"1\n{END}All is well.\n\n2\n00:00:0", "broken"),
        (f"1\n{END}All is well.\n\n2", "broken"),
        (f"1\n{END}All is well.\n\n2\n{END}", "broken"),
        (f"1\n{END}All is well.\n\n2\n00\n\nMore at www.subs.example", "broken"),
        (f"1\n{END}[door sl", "broken"),
        (f"1\n{END}[door slams]", "whole"),
        (f"1\n{END}♪ la la ♪", "whole"),
        (f"1\n{END}♪ la la", "broken"),
        (f"1\n{END}They took the hou", "word"),
        (f"1\n{END}They took the hou\n\nWatch free on https://subs.example/12", "word"),
        (f"1\n{END}They took the hou\n(tapes)", "word"),
        (f"1\n{END}They took the house...", "open"),
        (f"1\n{END}Room 12", "word"),
        (f"1\r\n{END}All is well.\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nRate this file at www.subs.example", "whole"),
        ("   ", "whole"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text, "tapes")[0] == kind


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(2)
    x = np.floor(np.exp(rng.normal(6.5, 0.6, 20_000)))
    cut = x > 1000
    some = x[~cut]
    x1, x2 = np.log(some).sum(), (np.log(some) ** 2).sum()
    mean, sd, post = truncation.fit_limits([(1000.0, float(cut.sum()))], float(len(some)), x1, x2)
    assert abs(mean - 6.5) < 0.03 and abs(sd - 0.6) < 0.03 and post[1000.0] > 0.99


def corpus():
    rng = random.Random(6)
    nouns, verbs = ["house", "garden", "river", "lantern", "basket", "harbour", "bicycle"], ["took", "painted", "followed", "remembered", "carried"]

    def sentence():
        return f"They {rng.choice(verbs)} the {rng.choice(nouns)} near my {rng.choice(nouns)}{rng.choice(['.', '.', '.', '!', ''])}"

    rows = []
    for i in range(1500):
        text = "\n\n".join(f"{k}\n{END}{sentence()}" for k in range(1, rng.randrange(4, 30)))
        source, cut = rng.choice(["limit", "free"]), False
        if source == "limit" and len(text) > 1000:
            text, cut = text[:1000], True
        elif i % 40 == 0:
            text = text[: len(text) * 2 // 3]
            cut = True
        rows.append((i, text, source, cut))
    return rows


def features_of(spark, rows):
    return spark.createDataFrame([(s, i, [f"c{n}", f"b{n + 1000}"]) for i, (s, n) in enumerate(rows)], "source string, doc bigint, lengths array<string>")


def test_seldom_limits_are_found_among_many_common_lengths(spark):
    rows = [("big", n) for n in range(500, 620) for _ in range(40)] + [("big", 5000)] * 30 + [("small", n) for n in range(500, 620)] + [("small", 5000)] * 3
    got = {(r["source"], r["length"]): r["texts"] for r in truncation.source_limits(features_of(spark, rows)).collect() if r["posterior"] > 0.9}
    assert got == {("big", "c5000"): 30, ("small", "c5000"): 3, ("big", "b6000"): 30, ("small", "b6000"): 3}


def test_a_source_may_have_many_limits_and_a_text_many_forms(spark):
    rng = np.random.default_rng(3)
    limits = [1000 + 40 * i for i in range(60)]
    rows = [("a", int(n)) for n in np.exp(rng.normal(8, 1, 4_000))] + [("a", n) for n in limits for _ in range(12)]
    got = {r["length"]: r["posterior"] for r in truncation.source_limits(features_of(spark, rows)).collect()}
    assert {f"c{n}" for n in limits} <= {k for k, p in got.items() if p > 0.7} and len(got) < 2 * 60 + 10
    # forms without additions don't count in the distribution: the fit is that of the stored lengths
    forms = features_of(spark, rows).withColumn("lengths", F.concat("lengths", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.lit("c"), (F.col("doc") * 1000 + k * 100 + 10**8).cast("string")))))
    again = {r["length"]: r["posterior"] for r in truncation.source_limits(forms).collect()}
    assert all(again[k] == pytest.approx(p, abs=1e-9) for k, p in got.items() if k in {f"c{n}" for n in limits})


def test_cut_texts_are_found_by_limit_and_ending(spark):
    rows = corpus()
    extra = [(5000, None, "free", False), (5001, "", "free", False), (5002, f"1\n{END}Good.", None, False), (5003, "x" * 200_000, "free", False)]
    df = spark.createDataFrame([r[:3] for r in rows + extra], "doc_id bigint, text string, source string").withColumn("class", F.lit("clash"))
    got = {r["doc_id"]: r["cut"] for r in truncation.truncated_texts(df).collect()}
    assert 5000 not in got and 5001 not in got and not got[5002]
    assert all(v is not None for v in got.values())
    truth = {i for i, text, _, cut in rows if cut and not text.rstrip().endswith((".", "!"))}
    found = {d for d, cut in got.items() if cut and d < 5000}
    whole_words = {i for i, text, s, cut in rows if cut and i % 40 == 0}
    assert len(found & truth) / len(truth) > 0.95
    assert len(found - truth - whole_words) <= 3
    shares = {r["source"]: r for r in truncation.truncation_by_source(truncation.truncated_texts(df)).collect()}
    assert shares["limit"]["share_cut"] > shares["free"]["share_cut"]
    assert truncation.truncated_texts(df.limit(0)).count() == 0
