"""Text, label and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(value: Column) -> Column:
    """SHA-256 of the string form."""
    return F.sha2(value.cast("string"), 256)


def six_digit_pseudonym(value: Column) -> Column:
    """A stable six-digit number from the first six hex digits of md5 (P25)."""
    head = F.conv(F.substring(F.md5(value.cast("string")), 1, 6), 16, 10).cast("long")
    return head % 900000 + 100000


def table_name(raw: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends, 'table' if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(name) > 0, name).otherwise("table")


def digits(value: Column) -> Column:
    """The first run of digits as a number, NULL without one."""
    return F.regexp_extract(value, r"[0-9]+", 0).try_cast("long")


def skill_key(module: Column, kind: Column) -> Column:
    return F.concat_ws("_", module, kind)


def skill_parts(skill: Column) -> tuple[Column, Column]:
    """Module and kind of a skill key; 'Unknown' for a key without an underscore."""
    has = skill.contains("_")
    return F.when(has, F.substring_index(skill, "_", 1)).otherwise(skill), F.when(has, F.substring(skill, F.instr(skill, "_") + 1, F.length(skill))).otherwise("Unknown")


def risk_band(p: Column, safe: float = 0.3, medium: float = 0.7) -> Column:
    """Safe, Medium or High."""
    return F.when(p <= safe, "Safe").when(p <= medium, "Medium").when(p.isNotNull(), "High")


def target_class(result: Column) -> Column:
    """Withdrawn, Fail, Success for Pass and Distinction, else NULL."""
    return F.when(result == "Withdrawn", "Withdrawn").when(result == "Fail", "Fail").when(result.isin("Pass", "Distinction"), "Success")


def at_risk(target: Column) -> Column:
    """1 for Withdrawn and Fail, else 0, also for NULL."""
    return F.when(target.isin("Withdrawn", "Fail"), 1).otherwise(0)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high], NULL staying NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def best_title(columns: list[str], keys: list[str], words: tuple[str, ...], placeholders: tuple[str, ...]) -> Column:
    """The first usable text among preferred keys, then among columns whose name holds one of words."""
    order = [k for k in keys if k in columns] + [c for c in columns if c not in keys and any(w in c.lower() for w in words)]
    usable = [F.when((F.trim(F.col(c).cast("string")) != "") & ~F.trim(F.col(c).cast("string")).isin(*placeholders), F.trim(F.col(c).cast("string"))) for c in order]
    return F.coalesce(*usable, F.lit(None).cast("string"))


def content_type(raw: Column, index: Column) -> Column:
    """video, document, quiz or forum by keyword; else by the parity of the row's index."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(low.rlike("video|lecture|record"), "video").when(low.rlike("pdf|doc|slide|content|resource|page|url"), "document")
        .when(low.rlike("quiz|test|exam|assess"), "quiz").when(low.rlike("forum|chat|wiki"), "forum")
        .when(index % 2 == 0, "video").otherwise("document")
    )


def duration_text(minutes: list[Column], pages: list[Column], default: str) -> Column:
    """'<n> min' from the first positive minute field, then '<n> pages', then a default."""
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double").cast("int"))
    said = [F.format_string("%d min", positive(c)) for c in minutes] + [F.format_string("%d pages", positive(c)) for c in pages]
    kept = [F.when(positive(c).isNotNull(), s) for c, s in zip([*minutes, *pages], said, strict=True)]
    return F.coalesce(*kept, F.lit(default))


def chapter_text(explicit: Column, first: Column, last: Column, default: str) -> Column:
    """An explicit chapter, else the week range, else a default."""
    weeks = F.when(first.isNotNull() & last.isNotNull(), F.format_string("Tuần %d - %d", first.cast("int"), last.cast("int")))
    return F.coalesce(F.when(F.trim(explicit) != "", F.trim(explicit)), weeks, F.lit(default))


def chapter_of(assignment: Column, explicit: Column, known: dict[str, str], default: str = "C1") -> Column:
    """As stated, else as named within the id, else looked up, else a default."""
    named = F.upper(F.regexp_extract(F.lower(assignment), "c[1-6]", 0))
    looked = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[assignment] if known else F.lit(None).cast("string")
    return F.coalesce(F.when(F.upper(explicit).rlike("^C[1-6]$"), F.upper(explicit)), F.when(named != "", named), looked, F.lit(default))


def friendly_label(student: Column, module: Column, ordinal: Column) -> Column:
    """'Student n (module)', 'Student n' or 'Unknown student' by what is present."""
    return F.when(student.isNull(), F.lit("Unknown student")).when(module.isNull(), F.concat(F.lit("Student "), ordinal.cast("string"))).otherwise(
        F.concat(F.lit("Student "), ordinal.cast("string"), F.lit(" ("), module, F.lit(")"))
    )
