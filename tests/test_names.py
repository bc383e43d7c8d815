import pytest

from sieveframe.functions.names import check_width, reserve, slug, unique_names, widened_names


@pytest.mark.parametrize("value, name", [
    (" ID ", "id"), ("Preço (R$)", "preco_r"), ("", "column"), (None, "column"), ("***", "column"), ("ﬁm", "fim"),
    ("straße", "strae"), (0, "column"), (12, "12")])
def test_slug(value, name):
    assert slug(value) == name


def test_unique_names_skip_taken():
    assert unique_names(["x", "X", "x 2", "x"]) == ["x", "x_2", "x_2_2", "x_3"]


def test_extra_names_avoid_collisions():
    assert widened_names(["a", "extra_1"], 4) == ["a", "extra_1", "_extra_1", "extra_2"]
    assert reserve("_sheet", ["_sheet", "__sheet"]) == "___sheet"


def test_width_limit():
    with pytest.raises(ValueError):
        check_width([])
    with pytest.raises(ValueError):
        widened_names(["a"], 2001)
