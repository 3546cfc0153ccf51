"""Review priority: score bands, settlement states, urgency, and batch states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROCESSING = ("UPLOADED", "QUEUED", "EXTRACTING", "OCR_PROCESSING", "AI_PROCESSING")
DONE = ("NORMAL", "CONFIRMED", "READY_TO_CONFIRM", "REVIEW_COMPLETED")


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "MISSING").when(score <= 0, "ZERO").when(score < 30, "CRITICAL").when(score < 50, "LOW").when(score < 70, "WARNING").when(score < 90, "GOOD").otherwise("EXCELLENT")


def in_bucket(score: Column, bucket: str) -> Column:
    """A filter's score bucket; unknown buckets let everything pass."""
    tests = {"MISSING": score.isNull(), "ZERO": score <= 0, "LT30": score < 30, "LT50": score < 50, "LT70": score < 70, "GE90": score >= 90}
    return F.coalesce(tests.get(bucket, F.lit(True)), F.lit(False))


def settlement(status: Column, explicit: Column | None = None) -> Column:
    found = (
        F.when(status.isin("CONFIRMED", "REVIEW_COMPLETED"), "SETTLED")
        .when(status.isin("NORMAL", "READY_TO_CONFIRM"), "READY_TO_SETTLE")
        .when(status.isin("NEED_SUPPLEMENT", "FAILED", "HAS_FAILED"), "ON_HOLD")
        .otherwise("UNSETTLED")
    )
    return found if explicit is None else F.coalesce(explicit, found)


def _urgencies(deadline: Column, status: Column, score: Column, failed: Column, supplement: Column) -> list[tuple[Column, int, str]]:
    """(condition, rank, reason), by rank. The reasons are fixed values."""
    many = lambda n: F.coalesce(n, F.lit(0)) > 0
    return [
        (deadline == "OVERDUE", 100, "마감일이 지났습니다."),
        (deadline == "TODAY", 95, "오늘 마감입니다."),
        ((status == "FAILED") | many(failed), 88, "처리 실패 항목이 있어 우선 확인이 필요합니다."),
        (deadline == "DUE_SOON", 85, "3일 이내 마감입니다."),
        ((status == "NEED_SUPPLEMENT") | many(supplement), 80, "보완 요청이 필요한 항목입니다."),
        (score.isNull() | (score <= 0), 78, "AI 추출 점수가 없거나 0점입니다."),
        (score < 30, 76, "AI 추출 점수가 30점 미만입니다."),
        (score < 50, 72, "AI 추출 점수가 50점 미만입니다."),
        (score < 70, 62, "AI 추출 점수가 70점 미만입니다."),
        (status.isin(*DONE), 20, "검증 통과 또는 확정 완료 항목입니다."),
    ]


def urgency_rank(deadline: Column, status: Column, score: Column, failed: Column | None = None, supplement: Column | None = None) -> Column:
    """The highest of what the deadline, the status (or a batch's counts) and the score ask for; finished rows without need are 20."""
    none = F.lit(0)
    return _first(_urgencies(deadline, status, score, none if failed is None else failed, none if supplement is None else supplement), 1, F.lit(50))


def urgency_reason(deadline: Column, status: Column, score: Column, failed: Column | None = None, supplement: Column | None = None) -> Column:
    """The reason that goes with ``urgency_rank``."""
    none = F.lit(0)
    return _first(_urgencies(deadline, status, score, none if failed is None else failed, none if supplement is None else supplement), 2, F.lit("일반 검토 항목입니다."))


def _first(cases: list[tuple], field: int, default: Column) -> Column:
    return F.coalesce(*[F.when(c[0], F.lit(c[field])) for c in cases], default)


def urgency_level(rank: Column) -> Column:
    return F.when(rank >= 90, "URGENT").when(rank >= 70, "HIGH").when(rank < 45, "LOW").otherwise("NORMAL")


def issue_count(explicit: Column, counts: list[Column], status: Column) -> Column:
    """The given number, or the sum of the counts, or 1 for a status that means trouble."""
    total = sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))
    return F.coalesce(explicit, F.when(total > 0, total), F.when(status.isin("NEED_REVIEW", "NEED_SUPPLEMENT", "FAILED"), 1).otherwise(0))


def batch_state(n: dict[str, Column]) -> Column:
    """The stored state of a batch from its counts: total, processing, failed, supplement, review, confirmed, normal."""
    ended = n["confirmed"] + n["supplement"] + n["failed"]
    return (
        F.when(n["total"] == 0, "UPLOADED")
        .when(n["processing"] > 0, "PROCESSING")
        .when(n["review"] > 0, "NEED_REVIEW")
        .when(n["normal"] > 0, "READY_TO_CONFIRM")
        .when((ended == n["total"]) & (n["supplement"] + n["failed"] > 0), "REVIEW_COMPLETED")
        .when(ended == n["total"], "READY_TO_GENERATE")
        .when(n["supplement"] > 0, "NEED_SUPPLEMENT")
        .otherwise("NEED_REVIEW")
    )


def shown_state(n: dict[str, Column]) -> Column:
    """The state that lists show: it tells empty, partly failed and mixed batches apart."""
    return (
        F.when(n["total"] == 0, "EMPTY")
        .when(n["processing"] > 0, "PROCESSING")
        .when(n["review"] > 0, "NEED_REVIEW")
        .when(n["normal"] > 0, "READY_TO_CONFIRM")
        .when(n["confirmed"] + n["supplement"] + n["failed"] == n["total"], "REVIEW_COMPLETED")
        .when(n["failed"] > 0, "HAS_FAILED")
        .when(n["supplement"] > 0, "NEED_SUPPLEMENT")
        .otherwise("MIXED")
    )


def settlement_counts(n: dict[str, Column], explicit: dict[str, Column] | None = None) -> dict[str, Column]:
    """ready, settled, on_hold and unsettled files of a batch; a given number goes before a counted one."""
    given = explicit or {}
    pick = lambda k, counted: F.coalesce(given[k], counted) if k in given else counted
    out = {"ready": pick("ready", n["normal"]), "settled": pick("settled", n["confirmed"]), "on_hold": pick("on_hold", n["supplement"] + n["failed"])}
    rest = F.greatest(F.lit(0).cast("long"), n["total"] - out["ready"] - out["settled"] - out["on_hold"])
    return out | {"unsettled": pick("unsettled", rest)}


# The names of sorts, with their column and direction.
SORTS = {"urgent": ("urgency", "desc"), "latest": ("uploaded_at", "desc"), "oldest": ("uploaded_at", "asc"), "deadline_asc": ("deadline", "asc"), "deadline_desc": ("deadline", "desc"), "score_asc": ("score", "asc"), "score_desc": ("score", "desc"), "expense_date_asc": ("expense_date", "asc"), "expense_date_desc": ("expense_date", "desc"), "urgency_desc": ("urgency", "desc"), "urgency_asc": ("urgency", "asc"), "uploaded_at_desc": ("uploaded_at", "desc"), "uploaded_at_asc": ("uploaded_at", "asc"), "issue_count_desc": ("issue_count", "desc"), "issue_count_asc": ("issue_count", "asc"), "file_count_desc": ("file_count", "desc"), "file_count_asc": ("file_count", "asc")}


def review_order(sort: str | None, columns: dict[str, Column]) -> list[Column]:
    """Sort keys of a review list; ``columns``: urgency, deadline, score, expense_date, uploaded_at, issue_count, file_count.

    A missing deadline or expense date is the latest of all, a missing upload the earliest, a missing score comes
    last either way. Ties: urgency falling, deadline, score, then the latest upload. Unknown sorts are ``urgent``.
    """
    first, ties = review_place(sort, columns), review_ties(columns)
    return [F.asc(first), *ties]


def review_ties(columns: dict[str, Column]) -> list[Column]:
    return [F.desc(F.coalesce(columns["urgency"], F.lit(0))), F.asc_nulls_last(columns["deadline"]), F.asc(F.coalesce(columns["score"], F.lit(999.0))), F.desc_nulls_last(columns["uploaded_at"])]


def review_place(sort: str | None, columns: dict[str, Column]) -> Column:
    """``review_order``'s first key as a double that rises, alike for all sorts; see there for what is missing."""
    by, direction = SORTS.get(sort or "", SORTS["urgent"])
    up = direction == "asc"
    dated = by in ("deadline", "expense_date")
    value = F.coalesce(columns[by], F.lit(999.0 if up else -1.0)) if by == "score" else columns[by]
    if by in ("urgency", "issue_count", "file_count"):
        value = F.coalesce(value, F.lit(1 if by == "file_count" else 0))
    number = F.coalesce((value.cast("timestamp") if dated or by == "uploaded_at" else value).cast("double"), F.lit(float("inf") if dated else float("-inf")))
    return number if up else -number
