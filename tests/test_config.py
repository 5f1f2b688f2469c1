import pytest

from cuematch import MatchConfig, ScoringWeights
from cuematch import fixed_values as fv
from cuematch.config import check_weights


def test_weights_must_sum_to_one():
    check_weights([0.5, 0.5 + 5e-7])
    with pytest.raises(ValueError):
        check_weights([0.5, 0.51])
    with pytest.raises(ValueError, match="final"):
        ScoringWeights(final={"embedding": 0.9})
    with pytest.raises(ValueError, match="unknown"):
        ScoringWeights(final={"nothing": 1.0})


def test_nested_and_flat_forms_agree():
    default = ScoringWeights()
    assert ScoringWeights.from_mapping(default.nested()) == default
    assert ScoringWeights.from_mapping(default.flat()) == default
    assert default.nested() == fv.SCORE_WEIGHTS
    changed = ScoringWeights.from_mapping({"embedding": 0.45, "targets": 0.15, "semantic": {"emotion": 0.30, "narrative": 0.30}})
    assert changed.final["embedding"] == 0.45 and changed.semantic["narrative"] == 0.30
    assert changed.semantic["dialogue"] == 0.20


def test_config_from_options():
    config = MatchConfig.from_options({"RANK_TOP_N": "7", "ENABLE_AUDIO_AUX": "0", "low_confidence_threshold": "0.5", "other": 1})
    assert (config.rank_top_n, config.enable_audio_aux, config.low_confidence_threshold) == (7, False, 0.5)
    assert MatchConfig().candidate_union_limit == 180
    with pytest.raises(ValueError):
        MatchConfig(candidate_union_limit=0)


def test_taxonomy_size():
    assert len(fv.TAXONOMY) == 12
    names = [t for data in fv.TAXONOMY.values() for t in data["tags"]]
    assert len(names) == 122
    assert sorted({n for n in names if names.count(n) > 1}) == ["intimate", "release", "transition"]
    assert set(fv.CATEGORY_RULES) == set(fv.TAXONOMY)
