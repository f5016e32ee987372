"""The queries of this subpackage where executors can't import the package."""

import os

import pytest

from tests.test_workers import DATA, run_elsewhere


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_operators(tmp_path):
    run_elsewhere(tmp_path, ["op1_language_id", "op2_url_filter", "op4_toxicity", "op6_embedding_dedup", "op7_sentencepiece", "op10_html_extraction"])
