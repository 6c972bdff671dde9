import pytest

from sigmill import schema
from sigmill.settings import Settings, nearest_power_of_two


def test_defaults_and_round_trip():
    s = Settings()
    assert (s.Analysis.hopSize, s.Onset.segmentation, s.Pitch.maxFrequency) == (1024, "Uniform", 3000.0)
    assert Settings.from_json(s.to_json()) == s
    assert len(s.hash()) == 64 and s.hash() != s.with_(Analysis={"hopSize": 512}).hash()


def test_fill_and_strictness():
    assert Settings.from_dict({"Analysis": {"hopSize": 512}}, fill=True).Analysis.hopSize == 512
    for tree in ({"Analysis": {"hopSize": 512}}, {"Analysis": {}}):
        with pytest.raises(ValueError, match="missing"):
            Settings.from_dict(tree)
    with pytest.raises(ValueError, match="unknown"):
        Settings.from_dict({"Analysis": {"hop": 1}}, fill=True)
    with pytest.raises(ValueError, match="unknown branches"):
        Settings.from_dict({"Other": {}}, fill=True)


@pytest.mark.parametrize(("branch", "key", "value"), [("Analysis", "frameSize", 1000), ("Analysis", "frameSize", 16), ("Onset", "alpha", 2.0), ("BFCC", "dctType", "IV"), ("Analysis", "windowingType", "none")])
def test_ranges(branch, key, value):
    with pytest.raises(ValueError, match=key):
        Settings().with_(**{branch: {key: value}})


def test_zero_weights():
    with pytest.raises(ValueError, match="all zero"):
        Settings().with_(Onset={f"weight_{n}": 0.0 for n in ("hfc", "complex", "complexPhase", "flux", "rms")}).Onset.weights()


def test_names():
    assert len(schema.FEATURES) == 22 and len(schema.TIMBRAL) == 18 and "StrongPeak" not in schema.TIMBRAL
    assert [schema.feature(f) for f in schema.FEATURES] == list(range(22))
    assert schema.feature("spectralcrest") == 16 and schema.is_cepstral("bfcc12") and not schema.is_cepstral("f0")
    assert schema.statistic("kurtosis") == 4
    for f in (schema.feature, schema.statistic):
        with pytest.raises(ValueError):
            f("other")


def test_powers_of_two():
    assert [nearest_power_of_two(x, 64, 8192) for x in (1, 90, 91, 1000, 10**6)] == [64, 64, 128, 1024, 8192]
