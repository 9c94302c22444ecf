"""Column helpers: hashing, text, labels, and the scalar mathematics of policy optimisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMMERCE_DOMAINS = ("retail", "shopping", "shopping_admin")
SERVICE_DOMAINS = ("airline", "telecom")
UNKNOWN_WORDS = ("", "unknown", "n/a", "none")
COST_NAMES = ("false_update", "unsafe_action", "stall", "verification", "budget_violation", "invalid_patch", "collateral_edit", "invalid_format")
AUTHORITATIVE = {
    "shopping": "order_service_api", "shopping_admin": "order_service_api", "retail": "order_service_api", "airline": "airline_booking_api",
    "telecom": "telecom_account_api", "database": "database_query", "tool_api": "workflow_service_api", "workflow": "workflow_service_api",
}
SECONDARY = {
    "shopping": "forwarded_customer_message", "shopping_admin": "forwarded_customer_message", "retail": "forwarded_customer_message",
    "airline": "travel_agency_forward", "telecom": "unverified_support_message",
}
SECONDARY_DEFAULT = "cached_tool_result"
LEAK = r"(?i)(decision|reason_code|conflict_type)\s*[:=]\s*(update|hold|ignore|[a-z_]{4,})|(relevant|condition|perturbation)\s*[:=]"
LATIN_SLUG = r"[^a-z0-9]+"


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0e0))


def hash_bucket(key: Column, seed: int, modulus: int) -> Column:
    """The first eight bytes of sha256("seed:key"), big-endian, modulo modulus."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(modulus).cast("decimal(20,0)")).cast("bigint")


def split_name(bucket: Column, first: int, second: int) -> Column:
    return F.when(bucket < first, "train").when(bucket < second, "dev").otherwise("test")


def export_split(key: Column, seed: int = 42) -> Column:
    return split_name(hash_bucket(key, seed, 10000), 8000, 9000)


def task_split(key: Column, seed: int = 42) -> Column:
    return split_name(hash_bucket(key, seed, 100), 75, 85)


def slug(x: Column, fallback: Column) -> Column:
    got = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), LATIN_SLUG, "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(got, F.lit("")), fallback)


def normal_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def unknown_value(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*UNKNOWN_WORDS)


def looked_up(table: dict[str, str], key: Column, fallback: Column) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, F.lower(key)), fallback)


def authoritative_source(domain: Column, fallback: Column) -> Column:
    return looked_up(AUTHORITATIVE, domain, fallback)


def secondary_source(domain: Column) -> Column:
    return looked_up(SECONDARY, domain, F.lit(SECONDARY_DEFAULT))


def macro_domain(domain: Column, wide: bool = False) -> Column:
    """wide: also takes the macro names themselves and travel."""
    d = F.lower(domain)
    commerce = (*COMMERCE_DOMAINS, "commerce") if wide else COMMERCE_DOMAINS
    service = (*SERVICE_DOMAINS, "service", "travel") if wide else SERVICE_DOMAINS
    return F.when(d.isin(*commerce), "commerce").when(d.isin(*service), "service").otherwise("workflow")


def label_leak(text: Column) -> Column:
    return F.regexp_like(text, F.lit(LEAK))


def valid_digest(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit("^[0-9a-fA-F]{64}$")), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def probability_ratio(new: Column, old: Column) -> Column:
    return F.exp(clip(new - old, -20, 20))


def clipped_ratio(new: Column, old: Column, eps: float) -> Column:
    return clip(probability_ratio(new, old), 1 - eps, 1 + eps)


def gradient_coefficient(new: Column, old: Column, advantage: Column, eps: float) -> Column:
    """advantage * ratio, but 0 where clipping holds the step back."""
    r = probability_ratio(new, old)
    held = ((advantage >= 0) & (r > 1 + eps)) | ((advantage < 0) & (r < 1 - eps))
    return F.when(held, F.lit(0e0)).otherwise(advantage * r)


def warm_cosine(iteration: Column, total: int, warmup_ratio: float) -> Column:
    """Linear warm-up (its length rounded half to even), then half a cosine."""
    if total <= 0 or not 0 <= warmup_ratio < 1:
        raise ValueError("total must be positive and warmup_ratio in [0, 1)")
    warm = round(total * warmup_ratio)
    step = iteration + 1
    decay = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (step - warm) / F.lit(float(max(1, total - warm)))))
    return F.when(step <= warm, step / F.lit(float(max(1, warm)))).otherwise(decay) if warm else decay


def token_loss_scale(tokens: Column, world: int, accumulation: int) -> Column:
    return F.lit(float(world * accumulation)) / tokens


def zero_costs() -> dict[str, Column]:
    return {name: F.lit(0e0) for name in COST_NAMES}


def base_task_key(dataset: Column, record: Column, parent: Column, field: Column) -> Column:
    """dataset:record without its :field suffix; the dataset is not put twice."""
    own = F.coalesce(F.nullif(record, F.lit("")), parent)
    tail = F.concat(F.lit(":"), field)
    bare = F.when(F.endswith(own, tail), F.left(own, F.length(own) - F.length(tail))).otherwise(own)
    return F.when(F.startswith(F.lower(bare), F.concat(F.lower(dataset), F.lit(":"))), bare).otherwise(F.concat_ws(":", dataset, bare))


def scenario_key(task: Column, split: Column, variant: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", task, split, variant.cast("string")), 256), 1, 16)


def slot_of(slots: Column, field: Column) -> Column:
    """First slot with the id, or null."""
    return F.get(F.filter(slots, lambda s: s["id"] == field), F.lit(0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0e0), lambda a, v: a + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0e0), lambda s, v: s + v)


def set_f1(truth: Column, predicted: Column) -> Column:
    """2|A and B| / (|A| + |B|) over distinct members; 1 for two empty sets."""
    a, b = F.array_distinct(truth), F.array_distinct(predicted)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1e0)).otherwise(F.lit(2e0) * F.size(F.array_intersect(a, b)) / total)


def first_failing(*rules: tuple[Column, str]) -> Column:
    """Message of the first rule whose condition holds; null if none does."""
    return F.coalesce(*(F.when(cond, F.lit(text)) for cond, text in rules))


def reason_codes(*rules: tuple[Column, str]) -> Column:
    """Ordered distinct codes whose conditions hold."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in rules))))


def request_digest(prompt_version: Column, model: Column, records: Column) -> Column:
    """sha256 over the fixed parts and the records in order of their id (records: array<struct<record_id, ...>>)."""
    return F.sha2(F.to_json(F.struct(prompt_version.alias("prompt_version"), model.alias("model"), F.array_sort(records).alias("records"))), 256)


def without_fence(text: Column) -> Column:
    """An answer without its Markdown code fence."""
    return F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", "")


def answers_of(text: Column) -> Column:
    """array<struct<record_id, observation_text>> of an answer: {"records": [...]} or an array; null if it is neither."""
    v = F.try_parse_json(without_fence(text))
    rows = F.coalesce(F.try_variant_get(v, "$.records", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return F.transform(rows, lambda r: F.struct(F.try_variant_get(r, "$.record_id", "string").alias("record_id"), F.try_variant_get(r, "$.observation_text", "string").alias("observation_text")))


def answers_complete(answers: Column, asked: Column) -> Column:
    """Whether the answers' ids are distinct and exactly those asked for."""
    ids = F.transform(answers, lambda a: a["record_id"])
    return F.coalesce((F.size(ids) == F.size(F.array_distinct(ids))) & (F.array_sort(ids) == F.array_sort(asked)), F.lit(False))


def label_plan(slot_ids: Column, field: Column, affected: Column, decision: Column, max_slots: int) -> dict[str, Column]:
    """Registry of slots (the first max_slots, with the observed field if there is room), one-hot affected slots, slot mask, and the verification label (-100: not counted)."""
    own = F.slice(slot_ids, 1, max_slots)
    registry = F.when(~F.array_contains(own, field) & (F.size(own) < max_slots), F.array_append(own, field)).otherwise(own)
    places = F.sequence(F.lit(0), F.lit(max_slots - 1))
    return {
        "registry": registry,
        "affected": F.transform(places, lambda i: F.coalesce(F.array_contains(affected, F.get(registry, i)), F.lit(False)).cast("int")),
        "slot_mask": F.transform(places, lambda i: ((i < F.size(registry)) & (decision != "IGNORE")).cast("int")),
        "verify_label": F.when(decision == "HOLD", F.lit(1)).otherwise(F.lit(-100)),
    }


def drawn_index(probabilities: Column, u: Column) -> Column:
    """Index of the first cumulative probability above u (inverse distribution function)."""
    cum = F.transform(F.sequence(F.lit(1), F.size(probabilities)), lambda n: F.aggregate(F.slice(probabilities, F.lit(1), n), F.lit(0e0), lambda a, v: a + v))
    return F.least(F.size(F.filter(cum, lambda c: c <= u)), F.size(probabilities) - 1)
