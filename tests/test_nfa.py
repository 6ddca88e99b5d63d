import itertools
import re

import pytest

from waymark.plans.nfa import Nfa, compile_regex, simple


@pytest.mark.parametrize("expression", ["a", "a+", "a b", "a+ b+", "(a|b)+ c", "a* b? c", "(a b|c)* a", "a|b c|c", "(a?)+ b", "((a|b) c)+"])
def test_agrees_with_re(expression):
    nfa, pattern = compile_regex(expression), re.compile(expression.replace(" ", ""))
    for n in range(5):
        for word in itertools.product("abc", repeat=n):
            assert nfa.accepts(list(word)) == bool(pattern.fullmatch("".join(word)))
            assert nfa.determinised().accepts(list(word)) == nfa.accepts(list(word))


@pytest.mark.parametrize("expression", ["", "  ", "(a", "a)", "|a", "a |", "+a", "a - b", "()"])
def test_malformed(expression):
    with pytest.raises(ValueError):
        compile_regex(expression)


def test_simple():
    assert simple("purchase+") == Nfa(((0, 1, "purchase"), (1, 1, "purchase")), (0,), (1,))
    assert simple("Domestic+Foreign").transitions == ((0, 1, "Domestic"), (1, 1, "Domestic"), (1, 2, "Foreign"))
    for bad in ("", "a|b", "(a)", "a*b", "a b!"):
        with pytest.raises(ValueError):
            simple(bad)


def test_determinised_has_one_run():
    nfa = Nfa(((0, 1, "a"), (0, 2, "a"), (1, 1, "a"), (2, 2, "a")), (0,), (1, 2))
    moves = nfa.determinised().transitions
    assert len({(f, x) for f, _, x in moves}) == len(moves)


def test_states_frame(spark):
    nfa = compile_regex("a*")
    assert {tuple(r) for r in nfa.states(spark).collect()} == {(0, "initial"), (0, "accepting"), (1, "accepting")}
