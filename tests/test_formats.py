"""Texts of graph dependencies."""

import pytest

from stratalens import ConfigError
from stratalens.operators.graphs import GFD, Literal, Pattern, format_gfd, parse_gfd


@pytest.mark.parametrize(
    "gfd",
    [
        GFD(Pattern(("blog", "account"), ((0, 1, "post"),)), (), (Literal(0, "author", 1, "name"),)),
        GFD(Pattern(("v", "v", "_"), ((0, 1, "e"), (2, 1, "e"))), (Literal(0, "style", 1, "style"),), (Literal(1, "style", -1, "filled"), Literal(2, "size", -1, "1.5"))),
        GFD(Pattern(("one",), ()), (), ()),
    ],
)
def test_dependencies_come_back(gfd):
    assert parse_gfd(format_gfd(gfd)) == gfd


def test_dependency_texts():
    text = '0.style=1.style 1.style=filled\n\ndigraph G {\n0[label="v"];\n 1 [ label = w ];\n0->1 [label=e];\n}\n'
    assert parse_gfd(text) == GFD(Pattern(("v", "w"), ((0, 1, "e"),)), (Literal(0, "style", 1, "style"), Literal(1, "style", -1, "filled")), ())
    for bad in ("", "graph G {\n}", "x\n\ngraph G {\n0[label=a];\n}", "\n\ngraph G {\n1[label=a];\n}"):
        with pytest.raises(ConfigError):
            parse_gfd(bad)
