"""Operator 10, secret scans: fixed patterns, and a randomness test battery. SQL functions only.

Base kinds (always reported): assign, access and hex, leftmost non-overlapping per kind.

The method adds spans of kind ``random``. A candidate is a maximal run of at least
``MIN_RUN`` characters of ``[A-Za-z0-9+/_=-]`` holding a digit and a letter. Its encoding is
inferred (hex, base32, lower-case or upper-case alphanumeric, alphanumeric, base64). Three
tests of "drawn uniformly from that alphabet" follow: chi-squared of the symbol counts, a
runs test around the alphabet's middle, and lag-one serial correlation. Simes' rule combines
their p-values into one, which holds though the last two lean on the same neighbours. False
discoveries are controlled twice, by the Benjamini-Hochberg rule within each length class:

* "not uniform" is a discovery of the battery's combined p-values at ``DISMISSED_WRONGLY``;
  such candidates go, so of those that go at most that share is expected to be random;
* short runs have little power to be told from uniform, so of the rest only those are
  reported that are also discoveries, at ``FALSE_DISCOVERY``, against "written text": the
  log-likelihood ratio of the uniform law to written text, standardised under the latter, so
  longer runs can reach smaller p-values.

Ranks come from counts over all candidates of the corpus, by length class and by p-value bin
of 1/20 decade, judged by the bin's larger edge; only these two count tables, of at most
``len(LENGTH_CLASSES) * (MAX_BIN + 1)`` rows each, reach the driver. A discovery is left out
only where base spans cover it whole.

Positions are running sums, worked out by blocks and blocks of blocks (``BLOCK``), and a text
is cut by blocks of ``CHARS`` characters, so the work is linear in the text and in its matches.

Defined results: null text is empty and has no span. Repeated rows give repeated results.
Positions are code points, ends exclusive. A very long text is one row, whole. An empty table
gives an empty result. Other columns, whatever their names, are passed over by report() and
kept by redact().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import store, take

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
MIN_RUN = 20
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN
#: Level of the battery: expected share of random runs among the candidates that it dismisses.
DISMISSED_WRONGLY = 0.001
#: Level of the reported spans: expected share of written text among them.
FALSE_DISCOVERY = 0.01
#: Lower bounds of the length classes.
LENGTH_CLASSES = (20, 32, 48, 96)
MAX_BIN = 6000
#: Items of an array that are summed up one after another, and characters of a text that are cut together.
BLOCK = 200
CHARS = 4096
KINDS = ("assign", "access", "hex", "random")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Written text, by class of character: characters and their share together.
WRITTEN = {"vowel": ("aeiou", 0.30), "common": ("nrstdhl", 0.36), "rare": ("bcfgjkmpqvwxyz", 0.12), "upper": (_UPPER, 0.05), "digit": (_DIGITS, 0.10), "mark": ("+/_=-", 0.07)}
#: Encodings in the order in which they are tried: name, pattern, alphabet.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("upper36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("alnum", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("url64", "^.*$", _UPPER + _LOWER + _DIGITS + "-_+/="),
)


def encoding_constants(alphabet: str) -> dict[str, float]:
    """Per class the log-likelihood ratio of one character, and its mean and deviation for written text restricted to the alphabet."""
    share = {c: p / len(chars) for chars, p in WRITTEN.values() for c in chars}
    mass = sum(share[c] for c in alphabet)
    gain = {c: math.log(1 / len(alphabet)) - math.log(share[c] / mass) for c in alphabet}
    mean = sum(share[c] / mass * gain[c] for c in alphabet)
    var = sum(share[c] / mass * (gain[c] - mean) ** 2 for c in alphabet)
    by_class = {k: next((gain[c] for c in chars if c in gain), 0.0) for k, (chars, _) in WRITTEN.items()}
    return by_class | {"mean": mean, "sd": math.sqrt(var), "k": float(len(alphabet))}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each item what the items before it come to under an associative operation (zero for the first).

    Appending to an array copies it, so a long array is scanned by blocks, whose totals are scanned in the same way.
    """

    def short(a: Column) -> Column:
        begun = F.struct(zero.alias("total"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(a, begun, lambda acc, x: F.struct(merge(acc["total"], x).alias("total"), F.array_append(acc["out"], acc["total"]).alias("out")), lambda acc: acc["out"])

    def long(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda j: F.slice(a, j * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, _scanned(F.transform(b, lambda x: F.aggregate(x, zero, merge)), zero, merge, levels - 1), lambda x, before: F.transform(short(x), lambda y: merge(before, y)))))

    if levels == 1:
        return short(values)
    return _let(values, lambda a: F.when(F.size(a) <= BLOCK, short(a)).otherwise(long(a)))


def _located(text: Column, regex: str, group: int | None = None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches; value is the match or a group of it."""
    pattern = F.lit(regex)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    gaps = F.split(text, regex, -1)
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("m"), value.alias("v")), lambda x: x["m"].isNotNull())
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(z: Column) -> Column:
        sizes = F.transform(z, lambda x: (F.length(x["gap"]) + F.length(x["m"])).cast("bigint"))

        def spans(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["v"].alias("value"))

        return F.zip_with(z, _scanned(sizes, F.lit(0).cast("bigint"), lambda x, y: x + y), spans)

    return F.when(F.regexp_like(text, pattern), _let(zipped, placed)).otherwise(empty)


def _pieces(text: Column) -> Column:
    """The text in blocks of CHARS characters."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHARS), F.lit(0))


def _piece(blocks: Column, a: Column, z: Column) -> Column:
    """Characters a to z (exclusive) of a text in blocks."""
    first, last = F.floor(a / CHARS).cast("int"), F.floor(z / CHARS).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    at = lambda x: (x % CHARS).cast("int")
    inside = F.substr(block(first), at(a) + 1, (z - a).cast("int"))
    across = F.concat(F.substr(block(first), at(a) + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(block(last), F.lit(1), at(z)))
    return F.when(first == last, inside).otherwise(across)


def _upper_tail(z: Column) -> Column:
    """-log10 of the normal tail beyond z, by Mills' ratio bounds for z > 3 and a logistic fit below."""
    far = (z * z / 2 + F.log(z * math.sqrt(2 * math.pi)) + F.log1p(1 / (z * z))) / math.log(10)
    near = F.log1p(F.exp(1.5976 * z + 0.070565 * z * z * z)) / math.log(10)
    return F.when(z > 3, far).otherwise(F.when(z < -6, 0.0).otherwise(near))


def _simes(upper: Column, *both: Column) -> Column:
    """-log10 of the combined p-value of an upper-tail and of two-tailed normal scores: the least of p(i) * n / i over the p-values in order."""
    two = math.log10(2)
    scores = F.array(F.struct(upper.alias("z"), F.lit(0.0).alias("sides")), *(F.struct(F.abs(z).alias("z"), F.lit(two).alias("sides")) for z in both))
    logs = F.sort_array(F.transform(scores, lambda s: F.greatest(_let(s["z"], _upper_tail) - s["sides"], F.lit(0.0))), asc=False)
    n = len(both) + 1
    return F.array_max(F.transform(logs, lambda lp, i: F.greatest(F.lit(0.0), lp - F.log10(n / (i + 1)))))


def _total(values: Column, start: float = 0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, v: a + v)


def _encoding(s: Column) -> Column:
    """The first encoding whose pattern fits, with its constants."""

    def constants(name: str, alphabet: str) -> Column:
        return F.struct(F.lit(name).alias("encoding"), F.lit(alphabet).alias("alphabet"), *(F.lit(v).alias(k) for k, v in encoding_constants(alphabet).items()))

    out = constants(ENCODINGS[-1][0], ENCODINGS[-1][2])
    for name, pattern, alphabet in reversed(ENCODINGS[:-1]):
        out = F.when(F.regexp_like(s, F.lit(pattern)), constants(name, alphabet)).otherwise(out)
    return out


def _battery(s: Column, n: Column, c: Column) -> Column:
    """struct<uniform, logp, encoding>: -log10 of the battery's combined p-value and of that of written text, under the encoding c; all sums are linear in the candidate's length."""
    k = c["k"]
    count = lambda chars: n - F.length(F.translate(s, chars, "")).cast("double")
    gain = sum((count(chars) * c[cls] for cls, (chars, _) in WRITTEN.items()), F.lit(0.0))
    logp = _upper_tail((gain - n * c["mean"]) / (c["sd"] * F.sqrt(n)))
    index = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.call_function("instr", c["alphabet"], ch).cast("double"))
    squares = _total(F.transform(F.array_distinct(F.split(s, "")), lambda ch: F.when(ch == "", 0.0).otherwise(F.pow(n - F.length(F.replace(s, ch, F.lit(""))), F.lit(2.0)))))
    chi_z = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))

    def tests(v: Column) -> Column:
        high = lambda x: F.when(x > k / 2, 1.0).otherwise(0.0)
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v) - 1).alias("b"))
        sums = F.struct(
            _total(v).alias("v"), _total(F.transform(v, lambda x: x * x)).alias("vv"), _total(F.transform(v, high)).alias("high"),
            _total(F.transform(pairs, lambda p: p["a"] * p["b"])).alias("ab"), _total(F.transform(pairs, lambda p: F.abs(high(p["a"]) - high(p["b"]))), 1.0).alias("runs"),
            F.get(v, F.lit(0)).alias("first"), F.element_at(v, -1).alias("last"),
        )
        return _let(sums, verdicts)

    def verdicts(t: Column) -> Column:
        mu = 2 * t["high"] * (n - t["high"]) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        runs_z = F.when(var > 0, (t["runs"] - mu) / F.sqrt(var)).otherwise(99.0)
        mean = t["v"] / n
        spread = t["vv"] - n * mean * mean
        lag = t["ab"] - mean * (2 * t["v"] - t["first"] - t["last"]) + (n - 1) * mean * mean
        serial_z = F.when(spread > 1e-9, lag / spread * F.sqrt(n)).otherwise(99.0)
        uniform = _simes(chi_z, runs_z, serial_z)
        return F.struct(uniform.alias("uniform"), logp.alias("logp"), c["encoding"].alias("encoding"))

    return _let(index, tests)


def _score(s: Column) -> Column:
    """The battery for the first encoding whose pattern fits."""
    return _let(_encoding(s), lambda c: _battery(s, F.length(s).cast("double"), c))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTH_CLASSES):
        out = F.when(n >= low, i).otherwise(out)
    return out


def _bin(log: Column) -> Column:
    return F.least(F.floor(log * 20), F.lit(MAX_BIN)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start,end,class,odd,bin,encoding>>: p-value bins of the battery (odd) and of written text (bin)."""
    found = _located(text, RUN)
    return F.transform(
        F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _score(m["value"]).alias("t"))),
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            _length_class(m["end"] - m["start"]).cast("int").alias("class"),
            _bin(m["t"]["uniform"]).alias("odd"),
            _bin(m["t"]["logp"]).alias("bin"),
            m["t"]["encoding"].alias("encoding"),
        ),
    )


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(_located(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= MIN_VALUE),
        "access": F.when(F.contains(text, F.lit("AKIA")), _located(text, ACCESS)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")),
        "hex": _located(text, HEX),
    }


def discovery_bins(found: DataFrame, bin: str, level: float, among: dict[int, int] | None = None) -> dict[int, int]:
    """Per length class the smallest bin that Benjamini-Hochberg accepts at the level, over all candidates.

    With among (the battery's limits by class), candidates that the battery dismisses stay in the number of tests but can't be discoveries.
    """
    c = found.select(F.explode("candidates").alias("c")).select("c.*")
    at = F.col(bin) if among is None else F.when(F.col("odd") < _limits(among)[F.col("class")], F.col(bin)).otherwise(-1)
    counts = c.groupBy("class", at.alias("at")).count().collect()
    out: dict[int, int] = {}
    for cls in {r["class"] for r in counts}:
        own = sorted(((r["at"], r["count"]) for r in counts if r["class"] == cls), reverse=True)
        total, rank = sum(n for _, n in own), 0
        for b, n in own:
            if b < 0:
                break
            rank += n
            if 10 ** (-b / 20) <= level * rank / total:
                out[cls] = b
    return out


def _limits(bins: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for cls in range(len(LENGTH_CLASSES)) for x in (cls, bins.get(cls, MAX_BIN + 1))])


def _exposed(spans: Column, base: Column) -> Column:
    """Those of the spans (in order) that base spans don't hold whole. Base spans that meet become one stretch; a span is held if the last stretch that begins before it ends after it."""
    longest = lambda b: _scanned(F.transform(b, lambda x: x["end"]), F.lit(-1).cast("bigint"), lambda x, y: F.greatest(x, y))

    def stretches(b: Column) -> Column:
        # how far the spans before each one reach, and all of them
        return _let(F.concat(longest(b), F.array(F.array_max(F.transform(b, lambda x: x["end"])))), lambda reach: begun(b, reach))

    def begun(b: Column, reach: Column) -> Column:
        begins = F.filter(F.transform(b, lambda x, i: F.struct(x["start"].alias("start"), F.get(reach, i).alias("before"), i.alias("i"))), lambda x: x["start"] > x["before"])
        return _let(begins, lambda g: F.transform(g, lambda x, j: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), F.get(reach, F.coalesce(F.get(g, j + 1)["i"], F.size(b))).alias("end"))))

    def apart(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x["rank"] == 0, x["end"]))
        held = _scanned(ends, F.lit(None).cast("bigint"), lambda x, y: F.coalesce(y, x))
        return F.transform(F.filter(F.zip_with(every, held, lambda x, until: F.struct(x.alias("x"), (F.coalesce(until, F.lit(-1)) >= x["end"]).alias("held"))), lambda y: (y["x"]["rank"] > 0) & ~y["held"]), lambda y: y["x"])

    merged = _let(F.array_sort(base), lambda b: F.when(F.size(b) == 0, F.slice(b, F.lit(1), F.lit(0))).otherwise(stretches(b)))
    return F.when(F.size(spans) == 0, spans).otherwise(_let(F.array_sort(F.concat(merged, spans)), apart))


def scan(docs: DataFrame, *keep: str, level: float = FALSE_DISCOVERY) -> DataFrame:
    """row (struct of the columns named in keep), base and spans (array<struct<start,rank,end>> in order; rank: see KINDS); one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_spans(text)
    bare = lambda col, rank: F.transform(col, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    base = F.concat(*(bare(kinds[k], i) for i, k in enumerate(KINDS[:3])))
    found = store(docs.select(F.struct(*keep).alias("row"), F.array_sort(base).alias("base"), candidates(text).alias("candidates")), "secret-spans")
    odd = discovery_bins(found, "odd", DISMISSED_WRONGLY)
    dismissed, lowest = _limits(odd), _limits(discovery_bins(found, "bin", level, odd))
    own = F.filter("candidates", lambda c: (c["odd"] < dismissed[c["class"]]) & (c["bin"] >= lowest[c["class"]]))
    own = F.transform(own, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", _let(own, lambda o: _exposed(o, F.col("base")))))
    return found.select("row", "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kinds, m["rank"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(take(docs, "doc_id", "text"), "doc_id")
    of = lambda rank: F.size(F.filter("spans", lambda m: m["rank"] == rank)).cast("long")
    return found.select(
        "row.doc_id",
        *(of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        of(3).alias("n_random"),
    )


def _marked(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each span; of spans that overlap, the first gets one, and all are gone."""
    kinds = F.array(*map(F.lit, KINDS))
    zero = F.lit(0).cast("bigint")

    def cut(blocks: Column) -> Column:
        done = _scanned(F.transform(spans, lambda m: m["end"]), zero, lambda x, y: F.greatest(x, y))
        both = F.zip_with(spans, done, lambda m, before: F.struct(m.alias("m"), before.alias("before")))
        kept = F.filter(both, lambda x: x["m"]["start"] >= x["before"])
        parts = F.transform(kept, lambda x: F.concat(_piece(blocks, x["before"], x["m"]["start"]), F.lit("["), F.get(kinds, x["m"]["rank"]), F.lit("]")))
        rest = _piece(blocks, F.array_max(F.transform(spans, lambda m: m["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(_let(_pieces(text), cut))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by a mark of its kind, n_chars following; rows and columns stay."""
    found = scan(docs, *docs.columns)
    found = found.withColumn("text", _marked(F.col("row.text"), F.col("spans")))
    same = F.size("spans") == 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
