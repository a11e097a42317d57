"""What a person has to check in a requirement, as column expressions.

The decision on whole notices is in :mod:`.verdicts`.  Defined results: a null
text gives a null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a person has to check, with the part that is kept.
CHECKS = {
    "學業成績": r"(?:學業|學期|學年)[^。；;，,\n\d]{0,12}?(\d{1,3}(?:\.\d+)?)\s*分",
    "操行成績": r"操行[^。；;，,\n\d]{0,12}?(\d{1,3}(?:\.\d+)?)\s*分",
    "排名": r"排名[^。；;，,\n\d]{0,6}?(\d{1,3}(?:\.\d+)?\s*%?)",
    "GPA": r"GPA[^。；;，,\n\d]{0,16}?(\d(?:\.\d+)?)",
    "繳交": r"(?:繳交|檢附|提交|撰寫|參加)[^。；;\n]{0,10}?(自傳|研究計畫|計畫書|推薦函|推薦信|作品集|面試|口試)",
}


def manual_checks(text: Column, checks: Mapping[str, str] = CHECKS) -> Column:
    """``label:value`` for whatever a person has to check, each once, by label
    and then in text order."""

    def found(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.concat(F.lit(f"{label}:"), v))

    return F.array_distinct(F.concat(*[found(k, p) for k, p in checks.items()]))
