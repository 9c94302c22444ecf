"""The corpus driver: a schedule of decision points from grounded sources, realisation in rounds, and gated publication.

``plan`` turns a pool of sources into the whole schedule with range arithmetic and joins on
positions; nothing is drawn on the driver, and wide rows are exchanged once. ``fill`` realises candidates in rounds over stored
tables: what a round rejects waits, in order, for the next one, as in a queue whose rejected units go
to its tail. ``build`` joins both, checks the result in the pass that writes it and publishes it only then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import labelling
from admitflow.operators.sequences import ordinal, release, schedule_remaining
from admitflow.session import discard, store

# Fixed values.
EVENT_SECONDS, SUCCESSOR_SECONDS = 600, 300
HOLD_SHARE = IGNORE_SHARE = 15
FULL_TOTAL = 6000
KINDS = {"UPDATE": "new_consistent", "HOLD": "tool_error_or_low_trust", "IGNORE": "explicit_conflict"}
SUCCESSOR_KIND = "verification_confirmed"
MACROS = tuple(labelling.MACRO_SHARE)
SOURCE = ("macro", "dataset", "record_id", "entity", "field_id", "value", "observed_at", "valid_from", "goal")
FEW_GROUPS = 10_000


def shares(targets: dict[str, int], count: int) -> dict[str, int]:
    """Largest remainders: count split in proportion to the targets; of equal remainders the larger target, then the later name."""
    total = sum(targets.values())
    whole = {k: t * count // total for k, t in targets.items()}
    order = sorted(targets, key=lambda k: (targets[k] * count % total, targets[k], k), reverse=True)
    for k in order[: count - sum(whole.values())]:
        whole[k] += 1
    return whole


def segments(total: int) -> list[tuple[str, str, int, int, int, int, int]]:
    """(macro, decision, first draw of the macro, draws, records a draw, events before, records before), in the order of the schedule."""
    targets = labelling.macro_targets(total)
    holds, ignores = shares(targets, total * HOLD_SHARE // 100), shares(targets, total * IGNORE_SHARE // 100)
    out, event, record = [], 0, 0
    for macro, n in targets.items():
        hold, ignore = holds[macro], ignores[macro]
        for decision, k, size, first in (("UPDATE", n - 2 * hold - ignore, 1, 0), ("HOLD", hold, 2, n - 2 * hold - ignore), ("IGNORE", ignore, 1, n - hold - ignore)):
            out.append((macro, decision, first, k, size, event, record))
            event, record = event + k, record + k * size
    return out


def _digest(seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), "macro", "dataset", "record_id", "field_id"), 256)


def _drawn(pool: DataFrame, total: int, seed: int) -> DataFrame:
    """pool with decision, draw (within the macro), event (over all, from 1), sequence (of its first record, from 1): one row per episode.

    Digests are spread evenly: a source's place in its macro is that in a slice of them, after the rows of the slices before. A source at
    place p of s has the draws p, p + s, p + 2s and so on. The digest is worked out again behind the exchange, not sent along.
    """
    spark, parts = pool.sparkSession, segments(total)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_slice = F.shiftright(F.conv(F.substring(_digest(seed), 1, 8), 16, 10).cast("long") * slices, 32)
    sliced = pool.where(F.col("macro").isin(*MACROS)).withColumn("_slice", at_slice)
    sizes = sorted(tuple(r) for r in sliced.groupBy("macro", "_slice").agg(F.count(F.lit(1))).collect())
    all_of = {m: sum(n for k, _, n in sizes if k == m) for m in MACROS}
    missing = {m for m, n in all_of.items() if not n}
    if missing:
        raise ValueError(f"the sources lack macro domains: {sorted(missing)}")
    draws = {m: sum(p[3] for p in parts if p[0] == m) for m in MACROS}
    begins, before = [], dict.fromkeys(MACROS, 0)
    for m, k, n in sizes:
        begins.append((m, k, before[m], all_of[m], draws[m]))
        before[m] += n
    begins = spark.createDataFrame(begins, "macro string, _slice long, _begin long, _all long, _draws long")
    dealt = sliced.repartition("macro", "_slice").withColumn("_key", _digest(seed))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("macro", "_slice").orderBy("_key")) - 1).drop("_key").join(F.broadcast(begins), ["macro", "_slice"])
    placed = placed.withColumn("_place", F.col("_begin") + F.col("_place")).where("_place < _draws").withColumn("_last", F.expr("(_draws - 1 - _place) div _all"))
    rounds = placed.withColumn("_thousand", F.explode(F.expr("sequence(0L, _last div 1000)"))).withColumn("_round", F.explode(F.expr("sequence(_thousand * 1000, least(_last, _thousand * 1000 + 999))")))
    drawn = rounds.withColumn("draw", F.col("_place") + F.col("_round") * F.col("_all"))
    part = F
    for macro, decision, first, k, size, event, record in parts:
        i = F.col("draw") - first
        part = part.when((F.col("macro") == macro) & i.between(0, k - 1), F.struct(F.lit(decision).alias("decision"), (i + (event + 1)).alias("event"), (i * size + (record + 1)).alias("sequence")))
    return drawn.withColumn("_part", part).select(*pool.columns, "draw", "_part.*")


def _others(asks: DataFrame, pool: DataFrame, seed: int, group: list[str]) -> DataFrame:
    """asks (event, group, entity, turn) with distractor: row number turn mod (others) by (entity, digest) among the group's rows of other entities, null if there are none. Stored."""
    order = [*group, "entity"]
    ranged = pool.select("macro", "dataset", "record_id", "field_id", "entity", "value").repartitionByRange(*order, _digest(seed)).withColumn("_key", _digest(seed)).sortWithinPartitions(*order, "_key")
    ranged = store(ranged.select(*order, "record_id", "value", F.monotonically_increasing_id().alias("_id")), "corpus-ranged", compression="zstd")
    split = ranged.withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    begins, before = [], 0
    for part, n in sorted(tuple(r) for r in split.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        begins.append((part, before))
        before += n
    begins = pool.sparkSession.createDataFrame(begins, "_part long, _begin long")
    placed = split.join(F.broadcast(begins), "_part").withColumn("n", F.col("_begin") + F.col("_in")).drop("_part", "_in", "_begin")
    runs = placed.groupBy(*order).agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = store(placed.groupBy(*group).agg(F.min("n").alias("begin"), F.count(F.lit(1)).alias("all")), "corpus-groups")
    near = asks.join(runs, order, "left").join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, group, "left")
    rest = F.col("all") - F.col("size")
    n = F.col("begin") + F.pmod(F.col("turn"), F.greatest(rest, F.lit(1)))
    near = near.withColumn("n", F.when(rest > 0, F.when(n < F.col("first"), n).otherwise(n + F.col("size"))))
    other = placed.select("n", F.struct("record_id", "entity", "value").alias("distractor"))
    out = store(near.join(other, "n", "left").select("event", "macro", "entity", "turn", "distractor"), "corpus-others", compression="zstd")
    discard(ranged, groups)
    return out


def _distractors(drawn: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """event, distractor per IGNORE: of the same field if another entity has it, else of the macro. Stored."""
    asks = drawn.where("decision = 'IGNORE'").select("event", "macro", "field_id", "entity", (F.col("draw") + 1).alias("turn"))
    picked = _others(asks, pool, seed, ["macro", "field_id"])
    alone = picked.where("distractor is null").drop("distractor")
    macros = [r[0] for r in alone.select("macro").distinct().collect()]
    if not macros:
        return picked
    any_field = _others(alone, pool.where(F.col("macro").isin(*macros)), seed, ["macro"])
    lonely = any_field.where("distractor is null").first()
    if lonely:
        raise ValueError(f"macro domain {lonely.macro} needs two entities")
    out = store(picked.where("distractor is not null").unionByName(any_field), "corpus-others", compression="zstd")
    discard(picked, any_field)
    return out


def plan(pool: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """The schedule of total records (a positive multiple of 20): 50/30/20 by macro domain, 70/15/15 by decision, each HOLD followed by its UPDATE.

    pool: macro, dataset, record_id, entity, field_id, value, observed_at, valid_from, goal, all rows distinct in (macro,
    dataset, record_id, field_id); it is read several times. Episodes of a macro take its sources in the order of a seeded digest,
    round and round. An IGNORE has a distractor: a source of another entity, of the same field if there is one. The clock of the
    schedule moves on by ten minutes an episode; a source keeps the lag of its validity. discard(result) when it is no longer read.
    """
    pool = pool.select(*SOURCE)
    drawn = _drawn(pool, total, seed)
    picked = _distractors(drawn, pool, seed)
    told = drawn.where("decision = 'IGNORE'").join(picked.select("event", "distractor"), "event")
    base = drawn.where("decision <> 'IGNORE'").withColumn("distractor", F.lit(None).cast(picked.schema["distractor"].dataType)).unionByName(told)

    shown = F.coalesce(F.col("distractor.entity"), F.col("entity"))
    value = F.coalesce(F.col("distractor.value"), F.col("value"))
    steps = F.when(F.col("decision") == "HOLD", F.array(F.struct(F.lit(0).alias("s"), F.lit("HOLD").alias("d")), F.struct(F.lit(1).alias("s"), F.lit("UPDATE").alias("d")))).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.col("decision").alias("d"))))
    out = base.withColumn("step", F.explode(steps))
    second, number = F.col("step.s") == 1, F.col("sequence") + F.col("step.s")
    clock = F.lit(labelling.CLOCK) + EVENT_SECONDS * F.col("event") + SUCCESSOR_SECONDS * F.col("step.s")
    lag = F.when(F.col("valid_from").isNotNull(), F.greatest(F.lit(0), F.col("observed_at") - F.col("valid_from")))
    kind = F.when(second, SUCCESSOR_KIND)
    for decision, name in KINDS.items():
        kind = kind.when(F.col("step.d") == decision, name)
    ident = lambda n: F.concat(F.lit("r"), F.lpad(n.cast("string"), 9, "0"))
    schedule = out.select(
        ident(number).alias("record_id"),
        number.alias("sequence"),
        F.concat_ws(":", "macro", "dataset", "record_id", F.concat(F.lit("episode-"), F.lpad(F.col("event").cast("string"), 9, "0"))).alias("group_id"),
        "macro",
        F.col("step.d").alias("decision"),
        kind.alias("observation_type"),
        F.when(F.col("step.d") == "HOLD", "VERIFY").otherwise("NO_VERIFY").alias("verification"),
        F.when(second, ident(F.col("sequence"))).alias("parent_id"),
        "dataset",
        F.col("record_id").alias("source_id"),
        "field_id",
        shown.alias("entity"),
        value.alias("value"),
        F.col("distractor.record_id").alias("distractor_id"),
        "goal",
        clock.cast("long").alias("observed_at"),
        (F.lit(labelling.CLOCK) + EVENT_SECONDS * F.col("event") - lag).cast("long").alias("valid_from"),
    )
    schedule._stored_at = picked._stored_at
    return schedule


def realised(candidates: DataFrame) -> DataFrame:
    """The deterministic stand-in for a text generator: candidates with observation_text and tokens. From the second attempt on, the text names its record."""
    text = F.concat(F.lit("For "), "goal", F.lit(", "), "field_id", F.lit(" of "), "entity", F.lit(" is "), F.coalesce("value", F.lit("unknown")), F.lit("."))
    again = F.when(F.col("attempt") > 0, F.concat(F.lit(" Reported again as "), "record_id", F.lit("/"), F.col("attempt").cast("string"), F.lit("."))).otherwise("")
    return candidates.withColumns({"observation_text": F.concat(text, again), "tokens": F.lit(0).cast("long")})


def text_issues(rows: DataFrame) -> Column:
    """Ordered codes of what is wrong with a realised row by itself (repeats of other rows are judged by fill)."""
    text, normal = F.coalesce("observation_text", F.lit("")), S.normal_text(F.coalesce("observation_text", F.lit("")))
    absent = F.col("value").isNotNull() & ~F.contains(normal, S.normal_text(F.col("value")))
    return S.reason_codes((F.trim(text) == "", "empty_observation_text"), (S.label_leak(text), "label_leakage"), (absent, "value_not_grounded"))


@dataclass
class Filled:
    """Accepted rows (with attempt and issues), rejected attempts, and the requests that a client with such batches makes."""

    accepted: DataFrame
    rejected: DataFrame
    requests: int
    _tables: list = field(default_factory=list)

    def discard(self) -> None:
        discard(*self._tables)


def _bits(places: DataFrame) -> DataFrame:
    """block, words: the places (column at) of each 4096 that there are, as bits of 64 longs."""
    words = places.groupBy(F.shiftright("at", 12).alias("block"), F.shiftright("at", 6).bitwiseAND(63).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask"))
    return words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m")).select("block", F.expr("transform(sequence(0L, 63L), i -> coalesce(m[i], 0L))").alias("words"))


def _marked(df: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """df with name: bits have its place. An eighth of a byte per row is broadcast, so that the rows stay where they are."""
    joined = df.withColumn("block", F.shiftright("at", 12)).join(F.broadcast(bits), "block", "left")
    return joined.withColumn(name, F.coalesce(F.expr("getbit(get(words, cast((at >> 6) & 63 as int)), cast(at & 63 as int)) = 1"), F.lit(False))).drop("block", "words")


def _requests(rounds: list[tuple[DataFrame, int, int]], batch: int) -> int:
    """How many batches a queue takes: full ones while it holds enough, then whatever is left, then what those rejected, and so on. rounds: rows (at, ok), how many, and how many of them are rejected."""
    judged, offset, held = None, 0, []
    for k, (table, n, rejected) in enumerate(rounds):
        if rejected:
            part = table.select("at", "ok")
            if k:  # the places of the first round are without gaps
                held.append(ordinal(part, ["at"], "q"))
                part = held[-1]
            else:
                part = part.withColumn("q", F.col("at"))
            part = part.where(~F.col("ok")).select((F.col("q") + offset).alias("q"))
            judged = part if judged is None else judged.unionByName(part)
        offset += n
    first, total = rounds[0][1], offset
    if judged is None:
        return -(-total // batch)
    requests = _batches(judged, first, total, batch)
    for numbered in held:
        release(numbered)
    return requests


def _batches(back: DataFrame, first: int, total: int, batch: int) -> int:
    # the queue before batch i holds first + rejected so far - taken; batches with rejections, and their running sums by blocks
    per_batch = back.groupBy(F.floor(F.col("q") / batch).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    running = per_batch.withColumn("before", F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("b", F.coalesce("before", F.lit(0)).alias("before"), "k")
    # the queue is short at batch i if first + rejected(before i) - i * batch < batch; between rejections it only shrinks
    held = running.select("b", "before", F.lead("b").over(Window.orderBy("b")).alias("next"), (F.col("before") + F.col("k")).alias("after"))
    short = lambda rejected: F.floor((F.lit(first) + rejected) / batch)  # noqa: E731  (least i with first + rejected - i * batch < batch)
    found = held.select(F.when(short(F.col("before")) <= F.col("b"), short(F.col("before"))).when(F.col("next").isNull() | (short(F.col("after")) <= F.col("next")), short(F.col("after"))).alias("i")).agg(F.min("i")).first()[0]
    i = found if found is not None else first // batch
    done = i * batch
    requests = i
    while done < total:
        rejected = back.where(F.col("q") < done).count()
        done = min(total, done + min(batch, first + rejected - done))
        requests += 1
    return requests


def fill(candidates: DataFrame, order: list[str], realise: Callable[[DataFrame], DataFrame] = realised, issues: Callable[[DataFrame], Column] = text_issues, max_attempts: int = 3, batch: int = 25, max_requests: int | None = None, ident: str = "record_id", seen: DataFrame | None = None, at: Column | None = None) -> Filled:
    """Realise every candidate until its text has no issue and no accepted text before it in the queue is the same.

    realise gets candidates with attempt (0, 1, ...) and adds observation_text; it runs once a round, and what it told is stored. The queue
    begins in the given (total) order, and rejected candidates go to its tail. at: a candidate's place in that order from 0, without gaps,
    if it is known. RuntimeError if a candidate is rejected max_attempts times or the queue needs more than max_requests batches. seen: one
    column, observation_text, of texts accepted before. Only texts and places are exchanged: who won its text is a bit per place.
    """
    keep, tables = candidates.columns, []
    if at is None:
        numbered = ordinal(candidates, order, "at")
        waiting = store(numbered, "fill-waiting", compression="zstd")
        release(numbered)
        tables.append(waiting)
    else:
        waiting = candidates.withColumn("at", at.cast("long"))
    normal = S.normal_text(F.coalesce("observation_text", F.lit(""))).alias("normal")
    known = [] if seen is None else [seen.select(S.normal_text(F.col("observation_text")).alias("normal")).distinct()]
    rounds, accepted, rejected, left, attempt = [], None, None, 1, 0
    while left:
        told = realise(waiting.withColumn("attempt", F.lit(attempt)))
        told = store(told.withColumn("issues", issues(told)), "fill-told", compression="zstd")
        claims = told.where(F.size("issues") == 0).select(normal, "at")
        for k in known:
            claims = claims.unionByName(k.select("normal", F.lit(-1).cast("long").alias("at")))
        first = claims.groupBy("normal").agg(F.min("at").alias("at"))
        won = store(_bits(first.where("at >= 0")), "fill-won")
        tables += [told, won]
        judged = _marked(told, won, "ok")
        n = told.count()
        left = n - (won.agg(F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + bit_count(w))"))).first()[0] or 0)
        odd = told.where(F.size("issues") > 0).select(normal, F.col("at").alias("own"))
        same = F.size("issues") == 0
        back = judged
        if left and odd.limit(1).count():
            also = store(_bits(odd.join(first, "normal").where("at < own").select(F.col("own").alias("at"))), "fill-same")
            tables.append(also)
            back, same = _marked(judged, also, "same"), same | F.col("same")
        back = back.where(~F.col("ok")).withColumn("issues", F.when(same, F.array_append("issues", F.lit("duplicate_text"))).otherwise(F.col("issues"))).select(*told.columns)
        rounds.append((judged, n, left))
        known.append(judged.where("ok").select(normal))
        good = judged.where("ok").drop("ok", "at")
        accepted = good if accepted is None else accepted.unionByName(good)
        rejected = back.drop("at") if rejected is None else rejected.unionByName(back.drop("at"))
        attempt += 1
        if left and attempt >= max_attempts:
            worst = back.orderBy("at").first()[ident]
            raise RuntimeError(f"quality attempts exhausted for {left} candidates, {worst} the first")
        waiting = back.select(*keep, "at")
    requests = _requests(rounds, batch)
    if max_requests is not None and requests > max_requests:
        raise RuntimeError(f"{requests} requests are needed, {max_requests} allowed")
    return Filled(accepted, rejected, requests, tables)


def report(rows: DataFrame, rejected: int, requests: int) -> DataFrame:
    """metric, key, n: the quality report of accepted rows, from one pass of partial aggregates and one over the groups."""
    count = lambda name, key: F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    kinds = {"decision": "decision", "macro_domain": "macro", "observation": "observation_type", "source": "dataset", "verification": "verification"}
    by = rows.select(F.explode(F.array(*(count(k, c) for k, c in kinds.items()))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c.metric", "c.key", "n")
    pairs = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") == 2).alias("paired_hold_groups"))
    sums = rows.agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    one = sums.join(F.broadcast(pairs), F.lit(True)).withColumns({"rejected": F.lit(rejected).cast("long"), "requests": F.lit(requests).cast("long")})
    names = ("accepted", "rejected", "requests", "paired_hold_groups", "total_tokens")
    flat = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).cast("long").alias("n")) for n in names))).alias("c")).select("c.*")
    return by.unionByName(flat)


def expectations(total: int) -> dict[str, tuple[Column, int]]:
    """What a finished corpus of total rows must hold: name -> (aggregate, value)."""
    targets = labelling.macro_targets(total)
    hold, ignore = total * HOLD_SHARE // 100, total * IGNORE_SHARE // 100
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    out = {"rows": (F.count(F.lit(1)), total), "HOLD": (is_("decision", "HOLD"), hold), "IGNORE": (is_("decision", "IGNORE"), ignore), "UPDATE": (is_("decision", "UPDATE"), total - hold - ignore)}
    out |= {m: (is_("macro", m), n) for m, n in targets.items()}
    out["successors"] = (F.count("parent_id"), hold)
    out["distractors"] = (F.count("distractor_id"), ignore)
    out["with issues"] = (F.count_if(F.size("issues") > 0), 0)
    return out


@dataclass
class Corpus:
    accepted: DataFrame
    rejected: int
    requests: int
    resumed: int


def build(pool: DataFrame, path: str, total: int = 140, seed: int = 42, batch: int = 25, max_attempts: int = 3, max_requests: int | None = None, confirm_full: int | None = None, done: DataFrame | None = None, realise: Callable[[DataFrame], DataFrame] = realised) -> Corpus:
    """Plan, fill, check and publish a corpus at path (Parquet). 6000 rows must be confirmed (confirm_full=6000).

    done: rows accepted before (record_id, sequence, observation_text); they must be the first of the schedule, and only the rest is
    realised. The rows are checked by metrics observed while they are written beside path; they are moved there only if all
    hold, else nothing is left and AssertionError tells what failed. Returns what path holds.
    """
    from admitflow.sources.sinks import publish_checked

    if total == FULL_TOTAL and confirm_full != FULL_TOTAL:
        raise ValueError("confirm_full must be 6000 for a full run")
    if batch <= 0 or (max_requests is not None and max_requests <= 0):
        raise ValueError("batch and max_requests must be positive")
    schedule, resumed = plan(pool, total, seed), 0
    rest = schedule
    if done is not None:
        planned, schedule = schedule, store(schedule, "corpus-plan", compression="zstd")
        discard(planned)
        resumed = done.count()
        rest = schedule_remaining(schedule, done.select("record_id", "sequence"), "record_id", ["sequence"])
    got = fill(rest, ["sequence"], realise, text_issues, max_attempts, batch, max_requests, seen=None if done is None else done.select("observation_text"), at=F.col("sequence") - (1 + resumed))
    discard(schedule)
    rejected = got.rejected.count()
    if done is None:
        checks = expectations(total)
    else:
        checks = {"rows": (F.count(F.lit(1)), total - resumed), "with issues": (F.count_if(F.size("issues") > 0), 0)}
    out = publish_checked(got.accepted, path, checks, compression="zstd")
    got.discard()
    return Corpus(out, rejected, got.requests, resumed)
