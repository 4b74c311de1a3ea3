"""Prefixes of addresses in texts."""

import pytest

from rillflow.engine import Engine


@pytest.mark.parametrize("text,prefix,want", [("10.10.0.7", "10.0.", False), ("10.10.0.7", "10.10.", True), ("from 10.0.3.4", "10.0.", True), ("seen.10.0.3.4", "10.0.", True), ("110.0.3.4", "10.0.", False), ("1.10.0.3", "10.0.3.4", False), ("at 10.0.3.4,", "10.0.3.4", True), ("at 10.0.3.45", "10.0.3.4", False)])
def test_a_prefix_starts_an_address(spark, text, prefix, want):
    assert [tuple(r) for r in Engine(spark).query(f"print a=has_ipv4_prefix('{text}', '{prefix}'), b=has_any_ipv4_prefix('{text}', '11.', '{prefix}')").collect()] == [(want, want)]
