import re

import pytest

from lumberline.functions.grok import GrokError, compile_grok


def test_named_only_and_types():
    g = compile_grok("%{LD:source}\t%{INT:id}\t%{WORD}")
    assert g.names == ["source", "id"]
    assert g.types == {"source": "string", "id": "int"}
    assert [c.group for c in g.captures] == [1, 2]


def test_group_numbers_skip_unnamed_and_count_plain_groups():
    g = compile_grok(r"(a|b)(?:c)(?<first>[()\]]+)\((?<second>x)(?<third>y)?")
    assert [(c.name, c.group, c.optional) for c in g.captures] == [
        ("first", 2, False), ("second", 3, False), ("third", 4, True),
    ]


def test_optional_through_alternation_and_quantifier():
    g = compile_grok("(?:%{INT:a}|%{WORD:b})(?: %{WORD:c})* %{WORD:d}")
    assert {c.name: c.optional for c in g.captures} == {"a": True, "b": True, "c": True, "d": False}


def test_top_level_alternation_makes_optional():
    assert all(c.optional for c in compile_grok("x%{INT:a}|y%{INT:b}").captures)


def test_custom_definitions_and_errors():
    g = compile_grok("%{WHO}", {"WHO": "user=%{INT:user}"})
    assert g.names == ["user"]
    with pytest.raises(GrokError):
        compile_grok("%{NOSUCHNAME:x}")
    with pytest.raises(GrokError):
        compile_grok("%{LOOP}", {"LOOP": "%{LOOP}"})


def test_every_shipped_definition_expands():
    from lumberline.functions.grok import COMMON_GROK, EXTRA_GROK

    for name in {**COMMON_GROK, **EXTRA_GROK}:
        g = compile_grok(f"%{{{name}:f}}")
        assert "%{" not in re.sub(r"%\{[^}]*$", "", g.regex)
        assert "f" in g.names
