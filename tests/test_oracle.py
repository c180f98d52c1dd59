"""A cross-section of the registered queries against DuckDB; ``verify.py`` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from juncture.plans import load_all
from juncture.plans.fixtures import BASE_TABLES
from verify import compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "read_alignments", "cigar_to_blocks", "parse_scap_info", "write_vcf", "variant_consequence", "parse_isoform_text",
    "normalize_junctions_se", "normalize_junctions_pe", "repair_constant_junctions", "isoform_catalog", "visible_isoforms",
    "isoform_filter_code", "variant_summary", "wildtype_summary", "replicates_wide", "bootstrap_null_by_count", "bonferroni_calls",
    "rank_cutoff", "exon_sdv_counts", "motif_enrichment", "spearman", "pr_curve", "f1_best", "nearest_exon", "annotate_exon",
    "codon_substitutions", "interval_filter", "expand_bedgraph", "bpp_max", "context_windows", "window_delta_scan",
    "delta_scores_usage", "score_batches", "categorize_dnvs", "segment_edit_distance", "created_site_flags", "stouffer_z_weighted",
    "merge_cadd", "merge_bpp", "pairs_wide", "compare_aligners", "single_end_outcomes", "isoform_totals", "bootstrap_null",
    "merge_population_contigs", "reference_windows_contigs", "nearest_exon_contigs", "interval_filter_contigs", "all_snvs_contigs",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    verdict, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert verdict == "ok"


def test_every_query_but_one_has_an_oracle():
    assert {name for name, q in load_all().items() if q.sql is None} == {"pair_effects"}
    assert load_all().keys() <= entry.queries().keys() and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
