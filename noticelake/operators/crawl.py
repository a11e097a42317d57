"""What became of a crawl: why it stopped, how complete it is, the state of a
program's source, and which kinds of address may be watched.

Defined results: null counts count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logic import cascade

# Reasons that leave a crawl incomplete, and kinds of address.
INCOMPLETE = ["entry_fetch_failed", "max_page_limit", "page_content_loop_detected", "pagination_exhausted_with_errors", "parallel_fetch_errors"]


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def stop_reason(looped: Column, requested: Column, pages: Column, detected: Column, queued: Column, errors: Column, most: int) -> Column:
    """Why a crawl page by page stopped: a page seen before, the limit, what failed,
    or that all is done."""
    return cascade(
        [
            (looped, "page_content_loop_detected"),
            ((_count(requested) >= most) & (_count(pages) < _count(detected)), "max_page_limit"),
            (_count(queued) > 0, "max_page_limit"),
            (_count(errors) > 0, "pagination_exhausted_with_errors"),
        ],
        "all_detected_pages_completed",
    )


def parallel_stop_reason(errors: Column, looped: Column, limited: Column) -> Column:
    """Why a crawl of known pages at once stopped."""
    return cascade([(_count(errors) > 0, "parallel_fetch_errors"), (looped, "page_content_loop_detected"), (limited, "max_page_limit")], "all_detected_pages_completed")


def completeness(mode: Column, detected: Column, succeeded: Column, reason: Column, errors: Column) -> Column:
    """How complete a crawl is: a run over first pages alone is incremental."""
    some = _count(succeeded) > 0
    return cascade(
        [
            ((mode == "incremental") & some, "incremental"),
            (mode == "incremental", "failed"),
            ((_count(errors) > 0) | reason.isin(INCOMPLETE), "partial"),
            (_count(succeeded) >= _count(detected), "complete"),
        ],
        "partial",
    )


def child_completeness(mode: Column, detected: Column, succeeded: Column, error: Column, parsed: Column) -> Column:
    """How complete a child site is: without announcements it never is."""
    failed = F.coalesce(error, F.lit("")) != ""
    return cascade(
        [
            (failed & (_count(succeeded) > 0), "partial"),
            (failed, "failed"),
            (_count(parsed) == 0, "partial"),
            (mode == "incremental", "incremental"),
            (_count(succeeded) >= _count(detected), "complete"),
        ],
        "partial",
    )


def child_stop_reason(complete: Column, parsed: Column) -> Column:
    return cascade([(_count(parsed) == 0, "no_announcements_parsed"), (complete == "incremental", "incremental_first_page"), (complete == "complete", "all_detected_pages_completed")], "page_fetch_or_pagination_incomplete")
