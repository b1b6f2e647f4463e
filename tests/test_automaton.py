import pytest

from pathweave.functions.automaton import Automaton


def test_final_defaults_to_the_number_of_states_and_states_are_checked():
    assert Automaton.of("1 5 2; 2 6 3").final == 3
    with pytest.raises(ValueError):
        Automaton(((1, 5, 4),), 3)


def test_trimming_keeps_only_useful_transitions():
    a = Automaton.of("1 5 2; 2 6 3; 2 7 4; 5 8 3", final=3)
    assert a.trimmed.transitions == ((1, 5, 2), (2, 6, 3))


def test_labels_and_successors_follow_states():
    a = Automaton.of("1 5 2; 2 6 2; 2 7 3")
    assert a.labels_from({2}) == [6, 7]
    assert a.successors({1}) == {2} and a.successors({2}) == {2, 3} and a.successors({3}) == set()


def test_branches_of_a_conjunction():
    a = Automaton.of("1 5 2; 2 6 2; 2 7 4; 1 8 3; 3 9 3; 3 11 4")
    assert a.branches[2] != a.branches[3]
    assert a.last_states == [2, 3]
    assert sorted(a.start_label_groups()) == [[5], [8]]


@pytest.mark.parametrize(
    "text, final",
    [
        ("1 5 2; 1 6 3; 2 7 4; 3 8 2", 4),  # branches meet before the end: fine for one branch, see below
        ("1 5 2; 2 6 1; 2 7 3", 3),  # enters the start state
        ("1 5 2; 2 6 3; 3 7 3", 3),  # leaves the final state
        ("1 5 2", 2),  # no state of its own
        ("1 5 2; 2 6 3; 2 7 4; 3 8 5; 4 9 5", 5),  # two last states in one branch
        ("1 5 2; 2 6 4; 1 7 3", 4),  # a branch that never ends
    ],
)
def test_branches_that_do_not_decide_a_conjunction_are_refused(text, final):
    a = Automaton.of(text, final)
    if text.startswith("1 5 2; 1 6 3"):
        assert len(set(a.branches.values())) == 1
    else:
        with pytest.raises(ValueError):
            a.branches
