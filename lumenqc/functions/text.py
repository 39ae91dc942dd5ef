"""Identifiers, paths, reasons and buckets as string columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")


def stable_id(path: Column, digits: int = 6) -> Column:
    """A readable, collision-resistant id of a path: safe stem, two underscores, digest."""
    safe = F.regexp_replace(stem(path), r'[<>:"/\\|?*]', "_")
    safe = F.when(F.trim(safe) == "", "image").otherwise(safe)
    return F.concat(safe, F.lit("__"), F.substring(F.sha2(normal_path(path), 256), 1, max(4, digits)))


def without_digest(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)__[0-9a-f]{4,10}$", "")


def fingerprint(size: Column, modified: Column, tag: Column, head: Column) -> Column:
    """16 digits over size, time, pipeline tag and the first bytes of the content."""
    first = F.encode(F.concat_ws(":", size.cast("string"), modified.cast("string"), tag), "UTF-8")
    return F.substring(F.sha2(F.concat(first, F.substring(head, 1, 65536)), 256), 1, 16)


def pipeline_tag(engine: str, quality: Column, mode: Column, extraction: Column) -> Column:
    return F.format_string(f"{engine}|%s|%s|%s", quality, mode, extraction)


def cached_parts(value: Column) -> tuple[Column, Column]:
    """Fingerprint and bucket of a cached ``fingerprint|bucket``."""
    parts = F.split(value, r"\|")
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def first_containing(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose needle the lower-cased text holds."""
    out = F.lit(otherwise)
    for needle, label in reversed(rules):
        out = F.when(F.lower(text).contains(needle), label).otherwise(out)
    return out


def normal_reason(reason: Column, prefixes: list[str], named: dict[str, str], most: int = 120) -> Column:
    """A reason without its prefix, by its known name, cut to ``most`` characters."""
    bare = F.trim(F.regexp_replace(reason, f"(?i)^(?:{'|'.join(prefixes)})", "")) if prefixes else F.trim(reason)
    lookup = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    return F.substring(F.coalesce(F.element_at(lookup, F.lower(bare)), bare), 1, most)


#: What marks an error text as exhaustion of memory.
EXHAUSTED = ("out of memory", "oom", "8007000e", "not enough memory", "failed to allocate", "bad allocation", "cuda_error_out_of_memory", "dml committed")
#: The reason that each tag counts as.
REASON_NAMES = {
    "weak_mask_small_area": "foreground_too_small", "weak_mask_low_opacity": "weak_mask", "weak_mask_mean_alpha": "weak_mask", "empty_mask": "weak_mask", "bbox_too_small": "foreground_too_small",
    "bbox_implausibly_thin": "foreground_fragmented", "mask_near_full_frame": "segmentation_unreliable", "bright_scene_weak_mask": "weak_mask", "foggy_soft_mask": "foggy_alpha_edges",
    "foggy_alpha_edges": "foggy_alpha_edges", "foreground_fragmented": "foreground_fragmented", "final_too_white_small_product": "product_faded", "final_washed_out": "product_faded",
    "final_bright_product_vanished": "product_faded", "product_faded": "product_faded", "low_object_contrast": "low_object_contrast", "catastrophic_structure_loss": "catastrophic_structure_loss",
    "quality_check_error": "quality_check_error", "rescue_failed": "rescue_failed", "decode_failed": "decode_failed", "source_unreadable": "source_unreadable",
    "fast_inference_failed_no_candidate": "fast_inference_failed_no_candidate", "final_save_failed": "final_save_failed", "unsupported_format": "unsupported_format", "no_candidate": "no_candidate",
}


def is_exhaustion(error: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(reduce(or_, (low.contains(x) for x in EXHAUSTED)), F.lit(False))


def qc_reason(reason: Column, most: int = 120) -> Column:
    """The reason's one name: by what its text says, else by table, else itself, cut to ``most`` characters; null stays null."""
    bare = F.trim(F.regexp_replace(reason, "mask_gate:|studio_gate:", ""))
    low = F.lower(bare)
    table = F.create_map(*(F.lit(x) for pair in REASON_NAMES.items() for x in pair))
    runtime = low.contains("onnxruntime") | low.contains("dmlfused")  # with the code 8007000e it is exhaustion
    return (
        F.when(low.contains("failed to decode") | low.contains("cannot identify image"), "decode_failed").when(low.contains("unsupported") & low.contains("format"), "unsupported_format").when(is_exhaustion(low), "inference_oom")
        .when(low.contains("compose_failed"), "compose_failed").when(F.try_element_at(table, bare).isNotNull(), F.try_element_at(table, bare)).when(runtime, "inference_runtime_error").when(bare == "", "segmentation_unreliable")
        .otherwise(F.substring(bare, 1, most))
    )


def failure_reason(error: Column, stage: Column) -> Column:
    """Why an item failed, from the error's text and the stage that it failed in; without an error there was no candidate."""
    low = F.lower(error)
    return (
        F.when(error.isNull(), "no_candidate")
        .when((F.coalesce(stage, F.lit("")) == "decode") | low.contains("failed to decode"), F.when(low.contains("unsupported"), "unsupported_format").otherwise("decode_failed"))
        .when(low.contains("source not found") | low.contains("no such file"), "source_unreadable").when(is_exhaustion(low), "inference_oom").when(low.contains("compose_failed"), "compose_failed")
        .when(low.contains("permission"), "final_save_failed").otherwise(qc_reason(error))
    )


def relative_to(path: Column, root: Column) -> Column:
    """The path below ``root``, both with plain slashes; a path elsewhere keeps its last part alone."""
    whole, base = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(whole.startswith(base), F.substring(whole, F.length(base) + 1, F.length(whole))).otherwise(F.element_at(F.split(whole, "/"), -1))


def index_keys(path: Column) -> Column:
    """Keys under which a file is looked up: its stem and, of ``..._IMG_0000``, the number with and without IMG_."""
    name = stem(path)
    up = F.upper(name)
    number = F.substring_index(up, "_IMG_", -1)
    return F.array_distinct(F.when(up.contains("_IMG_"), F.array(name, F.concat(F.lit("IMG_"), number), number)).otherwise(F.array(name)))


def case_keys(name: Column) -> Column:
    """Keys under which a case is looked for, the best first, each as it is and in capitals."""
    found = (name, F.upper(name), F.replace(name, F.lit("IMG_"), F.lit("")), F.concat(F.lit("IMG_"), name))
    return F.array_distinct(F.array(*(x for k in found for x in (k, F.upper(k)))))


def joined(tags: Column, by: str = ";") -> Column:
    return F.array_join(tags, by)
