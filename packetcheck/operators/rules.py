"""Consistency rules over two-sided rows.

A rule is data: a field name, the columns it reads and the functions it
compares by. ``broken()`` says where it fails, ``failure()`` what to report.
``reconcile`` applies an ordered list of rules to any DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.arrays import present
from packetcheck.functions.names import names_match
from packetcheck.functions.text import (
    compact_text, normalize_text, phone_digits, project_code,
)
from packetcheck.operators.stamps import needs_stamp

Normalizer = Callable[[Column], Column]
Matcher = Callable[[Column, Column], Column]
FAILURE_TYPE = "struct<field_name:string,message:string,values:map<string,string>>"


class ArrowNormalizer:
    """A normaliser over pandas series, evaluated in Arrow batches.

    ``fn`` gets texts without nulls. Candidates are normalised as one long series per batch. Spark
    evaluates a projection's functions together and equal calls once, so a suite whose
    rules share a normaliser passes its rows to Python once.
    """

    def __init__(self, fn: Callable[[pd.Series], pd.Series]):
        def one(values: pd.Series) -> pd.Series:
            return fn(values)

        def each(lists: pd.Series) -> pd.Series:
            sizes = [0 if x is None else len(x) for x in lists]
            flat = [v for x in lists if x is not None for v in x]
            known = pd.Series([v for v in flat if v is not None], dtype=object)
            done = iter(fn(known) if len(known) else [])
            flat = iter([None if v is None else next(done) for v in flat])
            return pd.Series([None if x is None else [next(flat) for _ in range(n)] for x, n in zip(lists, sizes)], dtype=object)

        self._one = F.pandas_udf(one, "string")
        self._each = F.pandas_udf(each, "array<string>")

    def __call__(self, c: Column) -> Column:
        return self._one(F.coalesce(c, F.lit("")))

    def each(self, c: Column) -> Column:
        return self._each(c)


def failure(field_name: str, message: Column | str, values: dict[str, Column]) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(field_name).alias("field_name"),
        message.alias("message"),
        F.create_map(*pairs).alias("values"),
    ).cast(FAILURE_TYPE)


def disagreement(sources: tuple[str, str]) -> str:
    return f"{sources[0]} 与 {sources[1]} 不一致"


@dataclass(frozen=True)
class FieldRule:
    """Left must equal right after normalising, or satisfy the matcher.

    An empty left side has nothing to check and passes.
    """

    name: str
    left: Column
    right: Column
    normalizer: Normalizer = normalize_text
    sources: tuple[str, str] = ("left", "right")
    matcher: Matcher | None = None
    applies: Column | None = None

    def broken(self) -> Column:
        left = self.normalizer(F.coalesce(self.left, F.lit("")))
        right = self.normalizer(F.coalesce(self.right, F.lit("")))
        differs = (left != "") & (left != right)
        if self.matcher is not None:
            differs = differs & ~self.matcher(self.left, self.right)
        return differs if self.applies is None else self.applies & differs

    def failure(self) -> Column:
        return failure(
            self.name,
            disagreement(self.sources),
            {self.sources[0]: self.left, self.sources[1]: self.right},
        )


@dataclass(frozen=True)
class CandidateRule:
    """Left must be one of the candidates after normalising."""

    name: str
    left: Column
    candidates: Column
    normalizer: Normalizer = normalize_text
    sources: tuple[str, str] = ("left", "right")

    def broken(self) -> Column:
        left = self.normalizer(F.coalesce(self.left, F.lit("")))
        if isinstance(self.normalizer, ArrowNormalizer):
            normalized = self.normalizer.each(self.candidates)
        else:
            normalized = F.transform(self.candidates, self.normalizer)
        known = F.array_contains(normalized, left)
        return (left != "") & ~F.coalesce(known, F.lit(False))

    def failure(self) -> Column:
        shown = F.when(F.size(self.candidates) > 0, F.array_join(self.candidates, " | "))
        return failure(
            self.name,
            disagreement(self.sources),
            {self.sources[0]: self.left, self.sources[1]: F.coalesce(shown, F.lit("<空>"))},
        )


class _MessageRule:
    """Rule whose first applying message, if any, is the failure."""

    def broken(self) -> Column:
        return self.message().isNotNull()

    def failure(self) -> Column:
        return failure(self.name, self.message(), self.evidence)


@dataclass(frozen=True)
class RangeRule(_MessageRule):
    """A range needs both ends in order."""

    name: str
    start: Column
    end: Column
    invalid: Column
    evidence: dict[str, Column] = field(default_factory=dict)

    def message(self) -> Column:
        no_start, no_end = self.start.isNull(), self.end.isNull()
        return (
            F.when(self.invalid, "开始时间晚于完成时间")
            .when(no_start & no_end, "Word 开始时间和完成时间未识别")
            .when(no_start, "Word 开始时间未识别")
            .when(no_end, "Word 完成时间未识别")
            .when(self.start > self.end, "开始时间晚于完成时间")
        )


@dataclass(frozen=True)
class IntervalRule(_MessageRule):
    """Two dates must lie inside a closed interval that itself must be sound."""

    name: str
    left: Column
    right: Column
    start: Column
    end: Column
    invalid: Column
    evidence: dict[str, Column] = field(default_factory=dict)

    def message(self) -> Column:
        def outside(date: Column, source: str) -> Column:
            return F.when(~date.between(self.start, self.end), source)

        where = F.concat_ws("、", outside(self.left, "Excel"), outside(self.right, "PDF"))
        return (
            F.when(self.left.isNull(), "Excel 验收日期未识别")
            .when(self.start.isNull(), "Word 开始时间未识别，无法校验验收时间区间")
            .when(self.end.isNull(), "Word 完成时间未识别，无法校验验收时间区间")
            .when(self.right.isNull(), "PDF 手写日期未识别")
            .when(
                (self.start > self.end) | self.invalid,
                "Word 开始/完成时间区间无效，无法校验验收时间",
            )
            .when(where != "", F.concat(where, F.lit(" 验收时间不在 Word 开始/完成时间区间内")))
        )


@dataclass(frozen=True)
class EvidenceRule:
    """A condition on one side demands evidence on the other."""

    name: str
    condition: Column
    evidence_present: Column
    text: str
    evidence: dict[str, Column] = field(default_factory=dict)

    def broken(self) -> Column:
        return self.condition & ~F.coalesce(self.evidence_present, F.lit(False))

    def failure(self) -> Column:
        return failure(self.name, self.text, self.evidence)


def reconcile(df: DataFrame, rules: Sequence) -> DataFrame:
    """Add ``failures`` in rule order and ``passed``."""
    found = present(*[(rule.broken(), rule.failure()) for rule in rules], kind=FAILURE_TYPE)
    return df.withColumn("failures", found).withColumn("passed", F.size("failures") == 0)


def exploded_failures(df: DataFrame, *keys: str) -> DataFrame:
    """One row per failure with its position in rule order.

    The outer form keeps the optimizer from adding a non-empty filter that
    would evaluate all rules a second time further down.
    """
    return (
        df.select(*keys, F.posexplode_outer("failures").alias("seq", "f"))
        .filter(F.col("seq").isNotNull())
        .select(*keys, "seq", "f.field_name", "f.message", "f.values")
    )


def packet_rules() -> list:
    """The fixed rule suite over the flat packet sides."""
    c = F.col
    dates = {
        "docx": c("doc_end"), "pdf": c("rep_date"), "开始时间": c("doc_start"),
    }
    return [
        FieldRule("项目编号", c("reg_code"), c("doc_code"), project_code, ("xlsx", "docx")),
        FieldRule(
            "项目编号", c("reg_code"), c("web_code"), project_code, ("xlsx", "web"),
            applies=c("has_web"),
        ),
        FieldRule("项目全称", c("reg_name"), c("doc_name"), compact_text, ("xlsx", "docx")),
        FieldRule(
            "项目全称", c("reg_name"), c("web_name"), compact_text, ("xlsx", "web"),
            applies=c("has_web"),
        ),
        CandidateRule(
            "用户姓名", c("reg_contact"), c("doc_names"), normalize_text, ("xlsx", "docx")
        ),
        FieldRule(
            "用户姓名", c("reg_contact"), c("rep_name"), normalize_text, ("xlsx", "pdf"),
            matcher=names_match,
        ),
        CandidateRule(
            "联系电话", c("reg_phone"), c("doc_phones"), phone_digits, ("xlsx", "docx")
        ),
        FieldRule("联系电话", c("reg_phone"), c("rep_phone"), phone_digits, ("xlsx", "pdf")),
        RangeRule(
            "竣工验收时间区间", c("doc_start"), c("doc_end"), c("doc_invalid"),
            {"excel": F.lit(None), **dates},
        ),
        IntervalRule(
            "验收时间", c("reg_date"), c("rep_date"), c("doc_start"), c("doc_end"),
            c("doc_invalid"), {"excel": c("reg_date"), **dates},
        ),
        EvidenceRule(
            "盖章检查", needs_stamp(c("amount")), c("has_red_stamp"),
            "合同额超过 50 万但 pdf 未识别到红章",
            {vocab.AMOUNT_LABEL: c("reg_amount"), "pdf_has_red_stamp": c("has_red_stamp")},
        ),
    ]
