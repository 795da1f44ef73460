"""Column predicates of entries, reviews, shelf items and boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_all

LIVE = ("pending", "draft", "reviewed")
TERMINAL = ("skipped", "revoked", "archived")
DAY = 86400
#: Days until the next review after so many remembered in a row.
LADDER = (1, 3, 7, 16, 35, 90)


def is_live(status: Column) -> Column:
    """Asked for as a note. The single source of truth: never written as "not revoked"."""
    return status.isin(*LIVE)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def display_text(text: Column, newest_draft: Column) -> Column:
    return F.coalesce(text, newest_draft)


def reviewable(status: Column, text: Column) -> Column:
    return F.coalesce((status == "reviewed") & (trim_all(text) != ""), F.lit(False))


def wants_notebook(destination: Column) -> Column:
    return destination.isin("notebook", "both")


def wants_obsidian(destination: Column) -> Column:
    return destination.isin("obsidian", "both")


def needs_transcribe(status: Column, ink_hash: Column, draft_hashes: Column) -> Column:
    """There is ink that no draft was made from, and the entry is still open."""
    return ink_hash.isNotNull() & ~status.isin("revoked", "mined", "skipped", "archived") & ~F.coalesce(F.exists(draft_hashes, lambda h: h == ink_hash), F.lit(False))


def handwriting(tool: Column) -> Column:
    return ~tool.isin("highlighter", "eraser", "eraser_area", "selection_brush")


def review_due(due: Column, updated: Column) -> Column:
    return F.coalesce(due, updated + DAY)


def review_advance(streak: Column, remembered: Column, now: Column) -> Column:
    """struct<streak, interval_days, due> after one review."""
    new = F.when(remembered, streak + 1).otherwise(0)
    days = F.element_at(F.array(*map(F.lit, LADDER)), (F.least(new, F.lit(len(LADDER) - 1)) + 1).cast("int"))
    return F.struct(new.alias("streak"), days.alias("interval_days"), (now + days * DAY).alias("due"))


def box_gap(a: str, b: str) -> Column:
    """Distance of two boxes given by the prefixes of their columns x0, y0, x1, y1; 0 if they touch."""
    dx = F.greatest(F.col(f"{a}x0") - F.col(f"{b}x1"), F.col(f"{b}x0") - F.col(f"{a}x1"), F.lit(0.0))
    dy = F.greatest(F.col(f"{a}y0") - F.col(f"{b}y1"), F.col(f"{b}y0") - F.col(f"{a}y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def valid_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F-]{36}$")


def shelf_done(busy: Column, deliver_status: Column, native_at: Column) -> Column:
    """Not busy, the last delivery did not fail, and there was one."""
    return ~busy & (F.coalesce(deliver_status, F.lit("")) != "failed") & (F.coalesce(native_at, F.lit(0)) != 0)


def shelf_stale(native_at: Column, mtime: Column) -> Column:
    return F.coalesce(native_at < mtime, F.lit(False))


def low_space(free: Column) -> Column:
    """Strictly less than 300 MiB; unknown is not low."""
    return F.coalesce(free < 314572800, F.lit(False))


def delivery_route(format: Column, size: Column, limit: int = 90 * 1000 * 1000) -> Column:
    """direct, large, or why not; a limit of 0 is none."""
    return (
        F.when(~format.isin("epub", "pdf"), "reject_format")
        .when(F.lit(limit == 0) | (size <= limit), "direct")
        .when(size <= 1 << 30, "large")
        .otherwise("reject_size")
    )


def canonical_ip(ip: Column) -> Column:
    """An IPv4 address mapped into IPv6 is that IPv4 address."""
    return F.regexp_replace(F.lower(ip), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")
