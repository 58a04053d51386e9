"""Category text, identifiers and paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each label, per dialect.
LABEL_DIALECTS: dict[str, dict[str, tuple[str, ...]]] = {
    "plain": {"Male": ("male", "m"), "Female": ("female", "f")},
    "binary": {"1": ("male", "m", "1", "1.0"), "0": ("female", "f", "0", "0.0")},
    "intake": {
        "Male": ("m", "male", "man"),
        "Female": ("f", "female", "woman"),
        "Other": ("other", "nonbinary", "non-binary"),
        "Prefer not to say": ("prefer not to say", "prefer_not_to_say", "unknown", ""),
    },
}
# Words that count as yes.
YES_WORDS = ("1", "true", "yes", "y", "consented")
# Direct-identifier columns that an intake table must not have.
FORBIDDEN_COLUMNS = (
    "name", "full_name", "email", "email_address", "phone", "phone_number",
    "address", "government_id", "aadhaar", "passport",
)


def normalize_label(text: Column, spellings: Mapping[str, Sequence[str]], otherwise: Column) -> Column:
    """Map accepted spellings (any case, trimmed) to their label."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for label, words in spellings.items():
        out = out.when(word.isin(*words), F.lit(label))
    return out.otherwise(otherwise)


def plain_label(text: Column) -> Column:
    return normalize_label(text, LABEL_DIALECTS["plain"], F.lit("Unknown"))


def binary_label(text: Column) -> Column:
    return normalize_label(text, LABEL_DIALECTS["binary"], F.lit(None).cast("string")).cast("int")


def intake_label(text: Column) -> Column:
    return normalize_label(text, LABEL_DIALECTS["intake"], F.trim(text))


def prefix_label(text: Column, prefix: str = "m") -> Column:
    """1 when the text starts with the prefix, else 0."""
    return F.coalesce(F.lower(F.trim(text)).startswith(prefix), F.lit(False)).cast("int")


def is_yes(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*YES_WORDS)


def split_list(text: Column, first: int | None = None, distinct: bool = False) -> Column:
    """Pipe list to trimmed, non-empty entries, first-seen order kept."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: x != "")
    if distinct:
        parts = F.array_distinct(parts)
    return parts if first is None else F.slice(parts, 1, first)


def join_list(items: Column) -> Column:
    return F.array_join(items, "|")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; paths elsewhere go under ``_abs/``; relative ones stay."""
    clean = slashes(path)
    base = root.rstrip("/") + "/"
    below = F.substring(clean, len(base) + 1, 1 << 30)
    return (
        F.when(clean.startswith(base), below)
        .when(clean.startswith("/"), F.concat(F.lit("_abs/"), F.regexp_replace(clean, "^/+", "")))
        .otherwise(clean)
    )


def same_path_suffix(left: Column, right: Column, depth: int = 3) -> Column:
    """Equal paths, or equal in the last ``depth`` parts (a moved root)."""
    def tail(path: Column) -> Column:
        parts = F.filter(F.split(slashes(path), "/"), lambda x: x != "")
        return F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), depth)

    present = F.coalesce((left != "") & (right != ""), F.lit(False))
    return present & ((slashes(left) == slashes(right)) | (tail(left) == tail(right)))


def is_fixed_name(path: Column, names: Sequence[str]) -> Column:
    """File name is one of ``names``, any case."""
    return F.upper(basename(path)).isin(*[n.upper() for n in names])


def name_part(path: Column, index: int, suffix: str = ".wav") -> Column:
    """Underscore part ``index`` (0-based) of the file name, NULL if there is none."""
    stem = F.replace(basename(path), F.lit(suffix), F.lit(""))
    return F.get(F.split(stem, "_"), F.lit(index))


def parse_item_name(path: Column) -> dict[str, Column]:
    """Entity id, item number and variant tag of ``<entity>_<number>[_aug<tag>].<ext>``."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    pattern = r"^(.*?)(?:_(\d+))?(?:_aug(.*))?$"
    found = lambda i: F.regexp_extract(stem, pattern, i)
    return {
        "entity_id": found(1),
        "item_no": F.nullif(found(2), F.lit("")).try_cast("int"),
        "variant": F.nullif(found(3), F.lit("")),
    }


def id_language(entity_id: Column, prefix: str) -> Column:
    """Second id part, when the id has at least three and starts with ``prefix``."""
    bits = F.split(entity_id, "_")
    fits = (F.size(bits) >= 3) & (F.upper(F.get(bits, F.lit(0))) == prefix.upper())
    return F.when(fits, F.lower(F.get(bits, F.lit(1)))).otherwise(F.lit(""))


def path_region(path: Column, tag: str = "DR", top: int = 8) -> Column:
    """Number of a ``/<tag><n>/`` folder in the path, 0 if there is none."""
    found = F.regexp_extract(path, rf"(?i)[/\\]{tag}([1-{top}])[/\\]", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def infer_source(
    declared: Column,
    entity_id: Column,
    path: Column,
    known: Mapping[str, int],
    id_prefixes: Mapping[str, Sequence[str]],
    name_prefixes: Mapping[str, Sequence[str]],
    default: str,
) -> tuple[Column, Column]:
    """(source, source id): declared if known, else by id, else by file name."""
    def by_prefix(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for label, prefixes in table.items():
            hit = F.lit(False)
            for prefix in prefixes:
                hit = hit | F.upper(text).startswith(prefix)
            out = out.when(hit, F.lit(label))
        return out

    said = F.upper(F.trim(declared))
    source = F.coalesce(
        F.when(said.isin(*known), said),
        by_prefix(entity_id, id_prefixes),
        by_prefix(basename(path), name_prefixes),
        F.lit(default),
    )
    numbers = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return source, F.element_at(numbers, source)
