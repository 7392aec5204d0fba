from tests.test_entry import run_elsewhere


def test_operators_run_from_any_folder(tmp_path):
    out = run_elsewhere(tmp_path, ["op2_ngram_join", "op3_packing", "op9_language_id"])
    assert "op2_ngram_join 200" in out and "op9_language_id 200" in out
