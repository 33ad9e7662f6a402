"""Text cut off by field limits (problem 8)."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.llm.subtitles import CUE_BREAK, TIME, WEB, lines_of, repaired
from skewline.session import written

#: Share of texts cut anywhere in transfer, as the prior where a length says nothing.
PRIOR = 0.02
#: Weight of a word form never seen at the end of a cue.
UNSEEN = 0.05
#: Share of a token's occurrences that may stand at the end of a cue by its layout alone.
STRAY = 0.001
#: A length is a candidate limit of a source if so many texts of it would be there by chance with this probability at most (its logarithm).
CHANCE = -11.5
#: Lengths on either side whose texts show what is natural at a length, beside the fitted distribution.
NEAR = 25

#: A word (lost characters inside it or at its end belong to it), a number, or a mark.
TOKEN = re.compile(r"[^\W\d_]+(?:[?\ufffd]+[^\W\d_]+)*\ufffd*|\d+|[^\w\s]")
_LETTER = re.compile(r"[^\W\d_]")

_WHOLE_TIME = re.compile(rf"^{TIME}[ \t]*-->[ \t]*{TIME}")
#: The start of a time line, broken off anywhere.
_PART_TIME = re.compile(r"^\d{1,2}(:(\d{1,2}(:(\d{1,2}([.,](\d{0,3}([ \t]*(-{1,2}|-->[ \t]*[\d:.,]*)?)?)?)?)?)?)?)?$")
_STOP = re.compile(r"(?:[.!?…♪♫\"”»)\]*]|--|—|</i>|</b>|</u>|\})$")


def without_additions(text: str, source: str | None) -> str:
    """``text`` (one kind of line end) without what was put after it: lines with web addresses or the source's name that
    have no time line of their own, and white space."""
    body = text.rstrip()
    while True:
        head, _, last = body.rpartition("\n")
        own = last.strip()
        name = source is not None and own.lower() == f"({source.lower()})"
        if not own or not (name or WEB.search(own)):
            return body
        if _WHOLE_TIME.match(head.rpartition("\n")[2].strip()):
            return body
        body = head.rstrip()


def ending(text: str, source: str | None) -> tuple[str, str, str]:
    """(class, last token, core): how the text ends.

    Classes: ``broken`` (inside a time line, a cue number, a tag or brackets), ``whole`` (a stop, a sound, a song, a web
    address), ``open`` (dots put at the end; what stands before decides if the length is a limit), ``word`` (a word, number or
    mark without a stop; the token decides).
    """
    core = without_additions(lines_of(repaired(text)), source)
    if not core.strip():
        return "whole", "", core
    last = core.rpartition("\n")[2].strip()
    before = core.rpartition("\n")[0]
    if _WHOLE_TIME.match(last):
        return "broken", "", core
    after_blank = before == "" or before.endswith("\n") or before.rstrip(" \t").endswith("\n")
    if last.isdigit() and after_blank:
        return "broken", "", core
    if _PART_TIME.match(last) and ":" in last:
        return "broken", "", core
    previous = before.rpartition("\n")[2].strip()
    if _PART_TIME.match(last) and after_blank is False and previous.isdigit():
        return "broken", "", core
    cue = CUE_BREAK.split(core)[-1]
    for a, b in (("[", "]"), ("(", ")"), ("{", "}"), ("<", ">")):
        if cue.rfind(a) > cue.rfind(b):
            return "broken", "", core
    if WEB.search(last):
        return "whole", "", core
    if last.endswith("\ufffd") and core.count("\ufffd") == 1:
        return "broken", "", core
    if last.endswith(("...", "…")):
        return "open", _last_token(last.rstrip(".…")), core
    if cue.count("♪") % 2:
        return "broken", "", core
    if _STOP.search(last):
        return "whole", "", core
    return "word", _last_token(last), core


def _last_token(line: str) -> str:
    found = TOKEN.findall(line)
    return ("#" if found[-1].isdigit() else found[-1].lower()) if found else ""


def _lengths(text: str, core: str) -> list[str]:
    """Lengths at which the text may have been cut, in characters ('c') and bytes ('b'): as stored (the first two), and without additions."""
    plain = lines_of(text)
    forms = {text, text.removesuffix("\n")}
    if len(core) < len(plain.rstrip()):
        place = text.find(core[-40:], max(0, len(text) - 600)) if core else -1
        if place >= 0:
            head = text[: place + len(core[-40:])]
            rest = text[len(head) :]
            space = rest[: len(rest) - len(rest.lstrip())]
            forms |= {head + space[:k] for k in range(len(space) + 1)}
    both = [[f"c{len(f)}", f"b{len(f.encode('utf-8', 'surrogatepass'))}"] for f in (text, *sorted(forms - {text}))]
    return both[0] + sorted({x for lengths in both[1:] for x in lengths} - {*both[0]})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its ending and lengths; per task the counts of tokens, and of those at the end of a cue."""
    words, ends, open_ends = Counter(), Counter(), Counter()
    chars = cues = 0

    def counts() -> pa.RecordBatch:
        forms = list(words)
        n = len(forms) + 1
        rows = {
            "doc": [None] * n,
            "source": [None] * n,
            "class": ["token"] * len(forms) + ["all"],
            "token": [*forms, None],
            "lengths": [None] * n,
            "total": [*map(float, words.values()), float(chars)],
            "ends": [*(float(ends[w]) for w in forms), float(cues)],
            "open_ends": [*(float(open_ends[w]) for w in forms), float(open_ends.total())],
        }
        return pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)

    for b in batches:
        out: dict[str, list] = {n: [] for n in _SCHEMA.names}
        for doc, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kind, token, core = ending(text, source)
            cases = CUE_BREAK.split(core)
            parts = [TOKEN.findall(cue.lower()) for cue in cases]
            for n, v in zip(_SCHEMA.names, (doc, source, kind, token, _lengths(text, core), None, None, None), strict=True):
                out[n].append(v)
            chars += len(text)
            words.update([w for p in parts[:-1] for w in p])
            words.update(parts[-1][:-1])
            for found, cue, following in zip(parts, cases, cases[1:], strict=False):
                # a sentence that goes on in the next cue doesn't end here
                letter = _LETTER.search(following)
                if found and letter and not letter.group().islower() and not cue.isupper():
                    cues += 1
                    i = len(found) - 1
                    while i and not found[i][0].isalnum() and found[i] not in ",:;":
                        i -= 1
                    ends[found[i]] += 1
                    if i == len(found) - 1:
                        open_ends[found[i]] += 1
        yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
        if len(words) > 300_000:
            yield counts()
            for c in (words, ends, open_ends):
                c.clear()
            chars = cues = 0
    if chars:
        yield counts()


_SCHEMA = pa.schema([("doc", pa.int64()), ("source", pa.string()), ("class", pa.string()), ("token", pa.string()), ("lengths", pa.list_(pa.string())), ("total", pa.float64()), ("ends", pa.float64()), ("open_ends", pa.float64())])
_SPARK_SCHEMA = "doc bigint, source string, class string, token string, lengths array<string>, total double, ends double, open_ends double"


def _upper_tail(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)


def fit_limits(counts: list[tuple[float, float]], n: float, s1: float, s2: float) -> tuple[float, float, dict[float, float]]:
    """Maximum likelihood of a log-normal length distribution with right-censored lengths, by expectation-maximisation.

    counts: (length, texts of that very length) of the candidates; n, s1, s2: number of all other texts, sum and sum of
    squares of their logarithms. Result: mean and deviation of the logarithms, and of each candidate the posterior
    that a text of that length was censored there: one less the expected natural share of its texts.
    """
    mean = s1 / n if n else 6.0
    sd = math.sqrt(max(s2 / n - mean * mean, 1e-4)) if n else 1.0
    post = {c: 1.0 for c, _ in counts}
    everything = n + sum(k for _, k in counts)
    for _ in range(30):
        a, b, m = s1, s2, n
        for c, k in counts:
            z = (math.log(c) - mean) / sd
            density = math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * c)
            post[c] = max(0.0, 1 - min(1.0, everything * density / k))
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / _upper_tail(z)
            e1 = mean + sd * hazard
            e2 = mean * mean + sd * sd + sd * (math.log(c) + mean) * hazard
            x = math.log(c)
            w = k * post[c]
            a += w * e1 + (k - w) * x
            b += w * e2 + (k - w) * x * x
            m += k
        mean, sd = a / m, math.sqrt(max(b / m - (a / m) ** 2, 1e-4))
    return mean, sd, post


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per candidate limit of a source, with the posterior of being cut there."""
    f = frame.iloc[0]
    out = []
    for unit in ("c", "b"):
        found = {float(x["length"]): (float(x["texts"]), float(x["near"])) for x in json.loads(f[f"top_{unit}"])}
        inside = [(c, k) for c, (k, _) in found.items()]
        n = float(f[f"n_{unit}"])
        if not inside or n <= 0:
            continue
        _, _, post = fit_limits(inside, n, float(f[f"s1_{unit}"]), float(f[f"s2_{unit}"]))
        # neither the fitted lengths nor those around may account for the texts
        out += [(f["source"], f"{unit}{int(c)}", max(min(post[c], 1 - found[c][1] / k), 0.0), k) for c, k in inside]
    return pd.DataFrame(out, columns=["source", "length", "posterior", "texts"])


def source_limits(features: DataFrame) -> DataFrame:
    """(source, length, posterior, texts): lengths at which a source's texts were cut ('c1000': characters, 'b2048': bytes).

    Texts are counted per source and length, in every form a text may have had when it was cut (combined on the map side). Lengths
    with more texts than chance puts there, given the lengths within ``NEAR`` (Chernoff's bound of a Poisson tail, one text more there for
    caution), are the source's candidates, however few or many. All other texts enter the fit once each, by the moments of their stored length.
    """
    features = features.withColumn("source", F.coalesce("source", F.lit("")))
    each = features.select("source", F.explode("lengths").alias("length"))
    counts = each.groupBy("source", "length").agg(F.count(F.lit(1)).alias("texts"))
    counts = counts.withColumn("unit", F.substring("length", 1, 1)).withColumn("value", F.expr("cast(substring(length, 2) as double)")).where("value > 0")
    around = Window.partitionBy("source", "unit").orderBy(F.col("value").cast("bigint")).rangeBetween(-NEAR, NEAR)
    counts = counts.withColumn("near", (F.sum("texts").over(around) - F.col("texts")) / (2.0 * NEAR))
    k, rate = F.col("texts"), F.col("near") + 1 / (2.0 * NEAR)
    top = counts.where((k > rate) & (k - rate + k * F.log(rate / k) <= CHANCE))
    lists = top.groupBy("source").agg(
        *[F.to_json(F.collect_list(F.when(F.col("unit") == u, F.struct(F.col("value").alias("length"), "texts", "near")))).alias(f"top_{u}") for u in ("c", "b")],
        *[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"_at_{u}") for u in ("c", "b")],
    )
    moments = []
    for i, u in enumerate(("c", "b")):
        value = F.expr(f"cast(substring(get(lengths, {i}), 2) as double)")
        rest = (value > 0) & ~F.arrays_overlap("lengths", f"_at_{u}")
        moments += [F.count_if(rest).alias(f"n_{u}"), *[F.coalesce(F.sum(F.when(rest, F.pow(F.log(value), p))), F.lit(0.0)).alias(f"s{p}_{u}") for p in (1, 2)]]
    texts = features.select("source", "lengths").join(lists.drop("top_c", "top_b"), "source").groupBy("source").agg(*moments)
    return texts.join(lists, "source").drop("_at_c", "_at_b").groupBy("source").applyInPandas(_fit_source, "source string, length string, posterior double, texts double")


def _evidence(features: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, ratio): logarithm of how much likelier the token ends a cut text than a whole one.

    A cut after any character ends in the token if it falls behind the token inside a cue, or inside a longer word that
    starts with it. A whole text ends in it as often as cues do without a stop.
    """
    sums = tokens.where("class = 'all'").agg(F.sum("total").alias("chars"), F.sum("ends").alias("cues"), F.sum("open_ends").alias("open_cues"))
    number = F.when(F.col("token").rlike("^[0-9]+$"), F.lit("#")).otherwise(F.col("token"))
    words = tokens.where("class = 'token'").withColumn("token", number).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("total", "ends", "open_ends")])
    asked = features.select("token").distinct()
    longer = (
        words.where("total >= 3 and length(token) between 2 and 40")
        .select(F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("_k"), "token", "total")
        .groupBy(F.expr("substring(token, 1, _k)").alias("token"))
        .agg(F.sum("total").alias("inside"))
    )
    known = asked.join(words, "token", "left").join(longer, "token", "left").na.fill(0.0)
    known = known.withColumns({c: sums.select(c).scalar() for c in ("chars", "cues", "open_cues")})
    cut = ((F.col("total") - F.col("ends")) * 2 + F.col("inside") + 1e-3) / F.col("chars")
    usual = F.col("ends") * (F.col("open_cues") / F.greatest(F.col("cues"), F.lit(1.0)))
    seen = F.greatest(F.greatest(F.col("open_ends"), usual) - F.col("total") * STRAY, F.lit(0.0))
    whole = (seen + UNSEEN) / F.greatest(F.col("cues"), F.lit(1.0))
    return known.select("token", F.log(cut / whole).alias("ratio"))


def truncated_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(``doc_id``, ``source``, ``score``, ``cut``, ...) of every text that isn't null or empty.

    A text that breaks off inside a time line, cue number, tag or brackets was cut, one that ends whole wasn't: by what a cut
    is, both whatever the length (``score`` is null). Of all others ``score`` is the logarithm of the odds that the text was cut: of its
    source's posterior where its length is one of the source's limits, else of the prior of a cut in transfer (where dots end the
    text: none), plus the evidence of its last token; it is ``cut`` above zero.

    Method: a log-normal length distribution, right-censored at candidate limits, is fitted to each source by maximum
    likelihood; a candidate's posterior follows from the texts found at the very length and those expected there. The evidence comes from the
    counts of the last token inside and at the end of cues over all texts, and of longer words that start with it.

    Scale: texts are read once, where they lie; what leaves the tasks is one short row per text and counts of tokens,
    written to the shared folder. Everything after works on those; only texts with a last token are joined to the evidence. A null source
    is a source of its own. Empty input gives no rows; repeated ids are judged each.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    read = written(rows.where("text is not null and text <> ''").mapInArrow(_read, _SPARK_SCHEMA), "endings")
    features = read.where("class not in ('token', 'all')").select("doc", "source", "class", "token", "lengths")
    tokens = read.where("class in ('token', 'all')").select("class", "token", "total", "ends", "open_ends")
    limits = source_limits(features).groupBy("source").agg(F.collect_list(F.struct("length", "posterior")).alias("_limits"))
    asked = features.where("class in ('word', 'open')")
    some = asked.withColumn("_name", F.coalesce("source", F.lit(""))).join(limits.withColumnRenamed("source", "_name"), "_name", "left").join(_evidence(asked, tokens), "token", "left")
    at = F.array_max(F.transform(F.filter("_limits", lambda x: F.array_contains(F.col("lengths"), x["length"])), lambda x: x["posterior"]))
    p = F.least(F.greatest(F.coalesce(at, F.lit(0.0)), F.lit(PRIOR)), F.lit(1 - 1e-4))
    score = F.when((F.col("class") == "word") | (at > PRIOR), F.log(p / (1 - p)) + F.coalesce("ratio", F.lit(0.0)))
    judged = some.withColumns({"limit_posterior": at, "score": score})
    told = features.where("class not in ('word', 'open')").withColumns({"limit_posterior": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    columns = ["doc", "source", "score", "class", "token", "limit_posterior"]
    both = judged.select(*columns).unionByName(told.select(*columns))
    return both.select(
        F.col("doc").alias(doc_id),
        F.col("source").alias(source),
        "score",
        F.coalesce(F.col("score") > 0, F.col("class") == "broken").alias("cut"),
        F.col("class").alias("ending"),
        F.col("token").alias("last_token"),
        "limit_posterior",
    )


def truncation_by_source(judged: DataFrame, source: str = "source") -> DataFrame:
    """(``source``, ``n_texts``, ``n_cut``, ``share_cut``) of the result of ``truncated_texts``."""
    return judged.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut")
    )
