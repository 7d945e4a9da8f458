"""Dimension policies: to which dimension a tag belongs, what it needs to stay there, and who wins.

Tags are rows (file, ordinal, code, via, parents, path, confidence): the code
of the disambiguating parent, the codes of all parents in order, and the
materialised path, each possibly null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arbitration import opposition_losers

# Dimensions of which a file takes one tag, and of which it takes several (fixed values).
SINGLE = """
builtin.file_type builtin.file_source builtin.application_data_segmentation builtin.audio_segmentation builtin.compressed_package_breakdown
builtin.operating_platform builtin.runtime_framework builtin.language_segmentation builtin.system_file_breakdown builtin.security_level
builtin.document_quality builtin.document_subdivision builtin.application_data_extensions builtin.database_extensions builtin.disk_image_extensions
builtin.font_segmentation builtin.system_file_extensions builtin.document_extensions builtin.text_extensions builtin.image_extensions
builtin.video_extensions builtin.audio_extensions builtin.compressed_package_extensions builtin.source_code_extensions builtin.program_extensions
builtin.ebook_extensions builtin.font_extensions builtin.source_of_work builtin.image_quality_level builtin.erotic_scale
builtin.mosaic_censorship_level builtin.watermark_level builtin.license_and_permit_categories builtin.generation_medium builtin.shot_size
builtin.illumination hownet.000000237195.n builtin.perspective builtin.system_ecology builtin.frame builtin.number_of_subjects builtin.text_density
builtin.time_season builtin.content_rating
""".split()
MULTI = """
builtin.file_purpose hownet.000000043396.n builtin.image_subdivision builtin.video_segmentation builtin.program_segmentation
builtin.program_ability_characteristics builtin.publication_status builtin.database_segmentation builtin.disk_image_segmentation
builtin.geographical_location builtin.processing_status builtin.software_nature builtin.travel_content builtin.financial_type builtin.game_type
builtin.subject_area builtin.e_book_segmentation builtin.theme builtin.music_type builtin.content_tags builtin.family_life_segmentation
builtin.text_subdivision builtin.source_code_segmentation builtin.comic_categories builtin.game_platform builtin.emotion_tags
builtin.photo_categories builtin.photo_quality builtin.contracts_bills_breakdown builtin.sensitive_content builtin.bloody_segmentation
builtin.political_subcategories builtin.violation_categories builtin.pornography_subgenres builtin.screenshot_categories builtin.layout
builtin.subject_type builtin.texture_style builtin.main_color builtin.family_incest_breakdown builtin.extramarital_lust_breakdown
builtin.teacher_student_erotica_breakdown builtin.workplace_erotica_breakdown builtin.multi_person_group_segmentation
builtin.sex_training_breakdown builtin.peep_wardrobe_malfunction_segmentation builtin.uniform_seduction_breakdown
builtin.erotic_literature_subcategories builtin.physiological_breakdown_of_desire builtin.involuntary_assault_breakdown
builtin.diverse_sexual_orientation_subcategories
""".split()
THRESHOLD = 0.60
# Opposed concepts by name: moods, then pictures (fixed values).
OPPOSED_MOODS = [("欢乐", "悲伤"), ("治愈", "致郁"), ("轻松", "紧张"), ("兴奋", "压抑")]
OPPOSED_PICTURES = [("有字图", "无字图"), ("横屏", "竖屏"), ("冷色调", "暖色调")]


@dataclass(frozen=True)
class Policies:
    """Dimension codes, and thresholds that differ from the usual one."""

    single: tuple[str, ...] = tuple(SINGLE)
    multi: tuple[str, ...] = tuple(MULTI)
    thresholds: dict[str, float] = field(default_factory=dict)

    def known(self, code: Column) -> Column:
        return F.coalesce(code.isin(*self.single, *self.multi), F.lit(False))

    def is_multi(self, dimension: Column) -> Column:
        return F.coalesce(F.trim(dimension).isin(*self.multi), F.lit(False))

    def threshold(self, dimension: Column) -> Column:
        if not self.thresholds:
            return F.lit(THRESHOLD)
        own = F.create_map(*[F.lit(x) for kv in self.thresholds.items() for x in kv])
        return F.coalesce(F.try_element_at(own, dimension), F.lit(THRESHOLD))


def tag_dimension(policies: Policies) -> Column:
    """The disambiguating parent, else the first parent, else the last path segment but for the tag
    itself, else the tag, that is a dimension; null without one."""
    known = policies.known
    parent = F.get(F.filter("parents", known), F.lit(0))
    steps = F.reverse(F.transform(F.split("path", "/"), lambda x: F.trim(x)))
    step = F.get(F.filter(steps, lambda x: known(x) & (x != F.col("code"))), F.lit(0))
    return F.coalesce(F.when(known(F.col("via")), F.col("via")), parent, step, F.when(known(F.col("code")), F.col("code")))


def survivors(tags: DataFrame, policies: Policies) -> DataFrame:
    """Tags with their dimension (null: none) that reach its threshold; NaN reaches none."""
    rows = tags.withColumn("dim", tag_dimension(policies))
    return rows.where(~F.isnan("confidence") & (F.col("confidence") >= policies.threshold(F.col("dim"))))


def arbitrate(tags: DataFrame, policies: Policies, opposed: list[tuple[str, str]]) -> DataFrame:
    """The tags that a file keeps: of dimensions that take one tag the most confident survivor, the
    first of equals; no loser of an opposed pair; each code once, where it comes first.

    A winner that loses to its opposite is not replaced by the runner-up.
    """
    rows = survivors(tags, policies)
    best = Window.partitionBy("file", "dim").orderBy(F.desc("confidence"), "ordinal")
    won = F.col("dim").isNull() | policies.is_multi(F.col("dim")) | (F.row_number().over(best) == 1)
    kept = rows.withColumn("__won", won).where("__won").drop("__won")
    if opposed:
        kept = kept.join(opposition_losers(rows, opposed), ["file", "code"], "left_anti")
    first = Window.partitionBy("file", "code").orderBy("ordinal")
    return kept.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def opposition_registry(pairs: DataFrame) -> DataFrame:
    """Unordered distinct pairs (a, b) of rows (a, b), none of a concept with itself."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
