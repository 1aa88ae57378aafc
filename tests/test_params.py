import pytest

from citeflow.params import DatasetParams, SplitRatios, dataset_tag


def test_tags():
    assert dataset_tag(DatasetParams()) == "10k_percent20_split801010_seed42"
    assert dataset_tag(DatasetParams(enriched=True, ratios=SplitRatios(0.9, 0.05, 0.05))) == "extended_10k_percent20_split900505_seed42"
    assert dataset_tag(DatasetParams(fraction=0.29)) == "10k_percent29_split801010_seed42"
    assert dataset_tag(DatasetParams(), "maker/model-x") == "model-x_10k_percent20_split801010_seed42"


@pytest.mark.parametrize(
    "make",
    [
        lambda: DatasetParams(corpus="11"),
        lambda: DatasetParams(fraction=0),
        lambda: DatasetParams(fraction=1.5),
        lambda: SplitRatios(0.8, 0.1, 0.2),
        lambda: SplitRatios(1.2, -0.1, -0.1),
        lambda: SplitRatios(1.0, 0.0, 0.0),
        lambda: SplitRatios.of({"train": 0.8, "dev": 0.1, "test": 0.1}),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_exact_shares():
    assert SplitRatios().rest_fraction() == (1, 5)
    assert SplitRatios.of({"train": 0.7, "valid": 0.1, "test": 0.2}).rest_fraction() == (3, 10)
