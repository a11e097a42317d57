"""Attachments of a notice: their links' roles and scores, the role of their
content, whether the rules are at hand, and the text that is evaluated.

Defined results: null labels, addresses and texts count as empty; a null array
has no entries; an empty content is ``uncertain``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import cascade
from ..functions.text import contains_any, hits, normalised
from .rows import top_within

# Labels of a link by role, in order of precedence, and bonuses.
LINK_ROLES = {
    "rules": ["辦法", "資格", "簡章", "評選", "規定", "要點", "申請須知"],
    "application_form": ["申請表", "推薦書", "報名表"],
    "supporting_document": ["證明書", "同意書", "切結書", "聲明書", "名冊"],
    "generic_attachment": ["附件", "附檔", "檔案", "文件下載", "下載文件"],
}
BONUS = {"rules": 80, "generic_attachment": 50, "application_form": 30, "supporting_document": 10}
DOCUMENT_LABELS = ["附件", "附檔", "下載", "辦法", "簡章", "資格", "評選", "推薦書"]
SUFFIX = r"\.(pdf|docx|doc|odt)$"
SHARED_HOSTS = ["drive.google.com", "docs.google.com"]
# Terms of an attachment's text.
CONTENT = {
    "supporting": ["切結書", "聲明書", "同意書", "證明書", "名冊", "證明文件"],
    "headers": ["申請資格", "申請對象", "資格條件", "申請條件", "申請辦法", "獎學金辦法", "獎助學金辦法", "評選辦法"],
    "requirements": ["學業", "操行", "成績", "排名", "年級", "科系", "學系", "系所", "日間部", "進修部", "在職", "戶籍", "低收入戶", "中低收入戶", "原住民", "截止"],
    "actions": ["可申請", "得申請", "提出申請", "學生申請", "限", "不受理", "不得申請"],
    "fields": ["申請人姓名", "姓名", "學號", "身分證字號", "聯絡電話", "簽章", "推薦人"],
}
# The context of an award.
SIGNALS = ["申請", "申請資格", "申請對象", "申請期間", "申請辦法", "截止", "應備文件", "獎學金", "助學金", "獎助學金", "補助金額", "獎勵金", "學年度", "學年"]
AWARDS = ["獎學金", "助學金", "獎助學金", "補助"]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def link_role(label: Column, pack: Mapping[str, Sequence[str]] = LINK_ROLES) -> Column:
    """The first role that a link's label names."""
    return cascade([(contains_any(_text(label), marks), role) for role, marks in pack.items()], "unrelated")


def path_suffix(url: Column) -> Column:
    """The document suffix of an address, in lower case; empty if it has none."""
    return F.regexp_extract(F.lower(F.regexp_extract(_text(url), r"^[^?#]*", 0)), SUFFIX, 1)


def is_document(url: Column, label: Column, labels: Sequence[str] = DOCUMENT_LABELS) -> Column:
    """An address that ends like a document, or a label that does or leads to a
    shared drive and names one."""
    named = contains_any(_text(label), labels)
    shared = F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)).isin(SHARED_HOSTS)
    ends = F.lower(F.regexp_replace(_text(label), r"[。．. ]+$", "")).rlike(SUFFIX)
    return (path_suffix(url) != "") | (named & (shared | ends))


def link_score(url: Column, label: Column, role: Column, pack: Mapping[str, Sequence[str]] = LINK_ROLES, bonus: Mapping[str, int] = BONUS) -> Column:
    """Points for the kind of file, the role and each label of rules."""
    kind = F.when(path_suffix(url) == "pdf", 10).when(path_suffix(url) == "odt", 7).otherwise(5)
    extra = F.lit(0)
    for name, points in bonus.items():
        extra = extra + F.when(role == name, points).otherwise(0)
    return kind + extra + 20 * F.size(hits(_text(label), pack["rules"]))


def inventory(links: DataFrame, key: str, k: int, pack: Mapping[str, Sequence[str]] = LINK_ROLES) -> tuple[DataFrame, DataFrame]:
    """From links ``key, spot, url, label``: the ``k`` best documents of a notice
    (``place`` by score, then ``spot``), and the counts of all of them by role."""
    found = links.where(is_document(F.col("url"), F.col("label"))).withColumn("role", link_role(F.col("label"), pack))
    found = found.groupBy(key, "url").agg(F.min_by(F.struct("spot", "label", "role"), "spot").alias("first")).select(key, "url", "first.*")
    found = found.withColumn("score", link_score(F.col("url"), F.col("label"), F.col("role"), pack))
    counts = found.groupBy(key).agg(F.count("*").alias("documents"), F.count_if(F.col("role") == "rules").alias("rules"), F.count_if(F.col("role") == "generic_attachment").alias("generic"))
    return top_within(found, key, [F.desc("score"), F.asc("spot")], k), counts


def content_role(text: Column, hint: Column, pack: Mapping[str, Sequence[str]] = CONTENT, least: int = 40) -> Column:
    """What an attachment's text is, whatever its link said."""
    t = normalised(_text(text))
    count = {name: F.size(hits(t, marks)) for name, marks in pack.items()}
    hinted = (hint == "rules") & (count["requirements"] >= 1) & ((count["headers"] >= 1) | (count["actions"] >= 1))
    rules = [
        (t == "", "uncertain"),
        (count["supporting"] >= 1, "supporting_document"),
        ((count["headers"] >= 1) & (count["requirements"] >= 2), "scholarship_rules"),
        (count["fields"] >= 3, "application_form"),
        (hinted, "scholarship_rules"),
        (F.length(t) >= least, "other"),
    ]
    return cascade(rules, "uncertain")


def rules_status(attachments: Column, required: Column, documents: Column, rules: Column, generic: Column) -> Column:
    """Whether a notice's rules are at hand: over its ``attachments`` (structs with
    ``status`` and ``content_role``), whether its body refers to one, and the
    counts of its links."""
    each = F.coalesce(attachments, F.array().cast(attachments_type()))
    read = F.exists(each, lambda a: F.coalesce(a["status"] == "success", F.lit(False)))
    found = F.exists(each, lambda a: F.coalesce((a["status"] == "success") & (a["content_role"] == "scholarship_rules"), F.lit(False)))
    steps = [
        (found, "resolved"),
        (required & (documents == 0), "declared_but_missing"),
        (rules > 0, "discovered_but_unresolved"),
        (generic > 0, "generic_document_unconfirmed"),
        (required, "discovered_but_unresolved"),
        ((documents > 0) & ~read, "discovered_but_unresolved"),
    ]
    return cascade(steps, "not_required")


def attachments_type() -> str:
    return "array<struct<status:string,content_role:string,text:string>>"


def evaluation_text(body: Column, attachments: Column, model_text: Column, model_scope: Column) -> Column:
    """Body, texts of rules that were read, and the model's text if its scope
    allows one; a scope and a text that contradict each other fail the job."""
    said, scope = _text(model_text) != "", F.coalesce(model_scope, F.lit("none"))
    wrong = said != (scope != "none")
    each = F.coalesce(attachments, F.array().cast(attachments_type()))
    rules = F.transform(F.filter(each, lambda a: (a["status"] == "success") & (a["content_role"] == "scholarship_rules")), lambda a: a["text"])
    parts = F.filter(F.concat(F.array(body), rules, F.array(F.when(scope != "none", model_text))), lambda p: _text(p) != "")
    return F.when(wrong, F.raise_error(F.lit("model text and scope contradict each other")).cast("string")).otherwise(F.array_join(parts, "\n"))


def related(title: Column, body: Column, anchors: Column, signals: Sequence[str] = SIGNALS, awards: Sequence[str] = AWARDS) -> Column:
    """Whether a text belongs to a title: it holds the title, or two signs of an
    award, or one and the title names an award or shares one of its ``anchors``."""
    bare = lambda v: F.regexp_replace(F.lower(_text(v)), r"(?U)[\W_]+", "")
    inside, name = bare(body), bare(title)
    count = F.size(hits(_text(body), signals))
    whole = (F.length(name) >= 6) & inside.contains(name)
    shared = F.coalesce(F.exists(anchors, lambda a: inside.contains(a)), F.lit(False))
    return (_text(body) != "") & (whole | (count >= 2) | ((count >= 1) & (contains_any(_text(title), awards) | shared)))
