"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from budgetsieve.llm.common import documents, fresh_path, table


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.byte_bpe import encode_documents

    return encode_documents(documents(spark, sf_dir)).drop("n_bytes")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.token_files import read_token_files, write_token_files

    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path)


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.ogg_media import media_column, media_features

    return media_features(media_column(documents(spark, sf_dir)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.decontamination import contamination

    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.ngram_join import link

    return link(documents(spark, sf_dir))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.suffix_dedup import dedup

    return dedup(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.line_dedup import report

    return report(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.quality import fit, rate

    docs = documents(spark, sf_dir)
    return rate(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.license_scan import report

    return report(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.periodic_runs import report, with_planted_runs

    return report(with_planted_runs(documents(spark, sf_dir)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from budgetsieve.llm.conversation_repair import report

    return report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ogg_media": op9_ogg_media,
    "op10_decontamination": op10_decontamination,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

def _oracles() -> dict[str, str]:
    from budgetsieve.llm import conversation_repair, decontamination, license_scan, line_dedup, ngram_join, periodic_runs

    own = {"op1_ngram_join": ngram_join.SQL, "op6_line_dedup": line_dedup.SQL, "op10_decontamination": decontamination.SQL}
    return own | {"op11_license_scan": license_scan.SQL, "op12_periodic_runs": periodic_runs.SQL, "op13_conversation_repair": conversation_repair.SQL}


ORACLE_SQL: dict[str, str] = _oracles()
