"""Scalar functions of the reports and readers: costs, routes, labels, keys, boxes, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_cost_micros(input_tokens: Column, output_tokens: Column, input_per_1k: Column, output_per_1k: Column) -> Column:
    """Micros of a dollar, half up; 0 without tokens, null without a rate. Rates are decimals."""
    exact = lambda x: x.cast("decimal(14,0)")
    usd_thousand = exact(input_tokens) * input_per_1k.cast("decimal(12,6)") + exact(output_tokens) * output_per_1k.cast("decimal(12,6)")
    return F.when((input_tokens == 0) & (output_tokens == 0), F.lit(0).cast("long")).otherwise(F.round(usd_thousand * F.lit(1000), 0).cast("long"))


def charged_cost(stored: Column, outcome: Column, has_tokens: Column, repriced: Column) -> Column:
    """The stored cost; a call that was never served costs nothing; a stored 0 with tokens is priced again."""
    unserved = outcome.isin("failed", "budget_refused", "account_refused") & ~has_tokens
    return F.when(stored.isNull(), F.when(unserved, F.lit(0).cast("long"))).when((stored == 0) & has_tokens, repriced).otherwise(stored)


def first_prefix(text: Column, prefixes: dict[str, str], otherwise: str) -> Column:
    """The name of the first prefix that the text starts with."""
    out = None
    for prefix, name in prefixes.items():
        out = F.when(text.startswith(prefix), name) if out is None else out.when(text.startswith(prefix), name)
    return out.otherwise(otherwise)


#: What a prompt's name says of its purpose, first match wins.
PURPOSES = {"review-assistant": "assistant", "reviewer-chat": "chat", "slot-row-choice": "row-choice", "findings-composer": "findings", "read": "reading"}


def infer_purpose(prompt_id: Column) -> Column:
    return first_prefix(prompt_id, PURPOSES, "other")


def infer_route(model_id: Column, prompt_id: Column, families: tuple[str, ...] = ("anthropic.", "amazon.", "meta.")) -> Column:
    """Which provider a call went through, by its prompt's name and its model's."""
    bare = F.regexp_replace(model_id, r"^(us|eu|apac)\.", "")
    family = F.lit(False)
    for f in families:
        family = family | bare.startswith(f)
    chat = F.when(prompt_id.contains("-anthropic-"), "anthropic").otherwise("openrouter")
    return F.when(prompt_id.startswith("review-assistant"), chat).when((bare != model_id) | family | bare.rlike(r"-v\d+:\d+$"), "bedrock").otherwise("unknown")


def usd(micros: Column) -> Column:
    """Six fixed places."""
    return (micros.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)").cast("string")


def delay_seconds(attempt: Column, base: float = 1.0, most: float = 60.0, draw: Column | None = None) -> Column:
    """Doubling waits up to a bound; half of each is jitter (draw from 0 to 1)."""
    whole = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return whole / 2 + whole / 2 * (F.lit(1.0) if draw is None else draw)


def iou_parts(a: Column, b: Column) -> Column:
    """struct<common, joined>: areas of intersection and union of integer boxes {x0,y0,x1,y1}."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    return F.struct((w * h).cast("long").alias("common"), (area(a) + area(b) - w * h).cast("long").alias("joined"))


def segment_distance2(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point to a segment (doubles), the foot clamped to the segment."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, size), F.lit(0.0))))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return ex * ex + ey * ey


def clearly_nearer(near2: Column, next2: Column, margin: float) -> Column:
    """sqrt(next2) - sqrt(near2) >= margin, without roots."""
    gap = next2 - near2 - margin * margin
    return next2.isNull() | ((gap >= 0) & (gap * gap >= 4 * margin * margin * near2))


def usual_minutes(pages: Column, low: tuple[float, float] = (3.0, 0.3), high: tuple[float, float] = (5.0, 0.5)) -> Column:
    """struct<low, high>: whole minutes, affine in the pages."""
    return F.struct(F.ceil(F.lit(low[0]) + F.lit(low[1]) * pages).cast("long").alias("low"), F.ceil(F.lit(high[0]) + F.lit(high[1]) * pages).cast("long").alias("high"))


def references(text: Column) -> Column:
    """Drawing references such as 3/A-401, as 3/A401, each once, as first seen."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b\d+\s*/\s*[A-Z]+-?\d+(?:\.\d+)?\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[\s-]", "")))


def revision_label(label: Column) -> Column:
    """A label that compares: without the word, case, marks and leading zeros."""
    bare = F.regexp_replace(F.upper(F.trim(label)), r"^(REVISION|REV)\b\.?\s*", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"[^A-Z0-9]", ""), r"^0+(?=\d)", ""), F.lit(""))


def date_readings(text: Column) -> Column:
    """Every date that a text may mean, day first and month first, each once and in order."""
    clean = F.regexp_replace(F.trim(text), r"[.\-]", "/")
    tries = [F.try_to_date(clean, f) for f in ("d/M/yyyy", "M/d/yyyy", "yyyy/M/d")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tries))))


def room_key(text: Column, synonyms: dict[str, str], dropped: tuple[str, ...] = ("the", "a", "of", "and", "room")) -> Column:
    """A sorted set of words: lower case, plural s dropped, synonyms mapped, filler words out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    stem = F.transform(words, lambda w: F.regexp_replace(w, r"(?<=[a-z]{3})s$", ""))
    named = F.transform(stem, lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), w), w)) if synonyms else stem
    return F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda w: ~w.isin(*dropped)))), " ")


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 over tagged parts; null differs from the empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v:"), p.cast("string")), F.lit("n")) for p in parts]), 256)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def json_numbers(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("long")


def json_contains(text: Column, *wanted: str) -> Column:
    """Whether a JSON array of texts holds all that is wanted; null for what is no array."""
    found = F.from_json(text, "array<string>")
    return F.when(found.isNotNull(), F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), found)) == 0)


def name_key(text: Column) -> Column:
    """A name that compares: without outer blanks and case; null stays null."""
    return F.lower(F.btrim(text))


def json_elements(text: Column, keep: Callable[[Column], Column]) -> Column:
    """Every element of a JSON array that passes, as an array of VARIANT in the array's order. U28.

    As a lax path does it, a value that is no array is an array of itself, and an element without what ``keep`` asks for
    does not pass. Null and what is no JSON have no elements; the text is parsed once."""
    doc = F.try_parse_json(text)
    return F.filter(F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc)), lambda e: doc.isNotNull() & F.coalesce(keep(e), F.lit(False)))


def text_at(element: Column, path: str) -> Column:
    """The text at a path of a VARIANT; null where there is none or it is no text."""
    found = F.try_variant_get(element, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(element, path, "string"))


#: Fixed value: the mark of an answer that was used again.
REUSED = "reused_from"


def made_a_call(packet: Column) -> Column:
    """Whether a stored invocation called a model: one whose packet names no answer that it reuses. All that counts calls,
    tokens or costs filters by this. F12."""
    return F.get_json_object(packet, f"$.{REUSED}").isNull()
