"""Golden cases of the chunker's written rules, and its invariants on arbitrary texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.operators.chunking import Options, chunk_text

PLAIN = Options(size=60, overlap=10, least=0, most_code=120)


def chunks(text, o=PLAIN):
    return chunk_text("d", text, o)


def kinds(text, o=PLAIN):
    return [(c["chunk_type"], c["content"]) for c in chunks(text, o)]


def flags(c):
    return dict(c["metadata"])


def test_nothing_comes_of_nothing():
    assert chunks(None) == chunks("") == chunks(" \n\t\n") == []


def test_options_are_checked():
    for wrong in ({"overlap": 60}, {"overlap": -1}, {"least": -1}, {"most_code": 59}):
        with pytest.raises(ValueError):
            Options(**{"size": 60, "overlap": 10, "least": 0, "most_code": 120, **wrong})


def test_headings_keep_a_stack():
    made = chunks("# A\n\none\n\n## B ##\n\ntwo\n\n# C#\n\nthree\n")
    assert [c["heading_path"] for c in made] == [["A"], ["A", "B"], ["C"]]
    assert [c["section_heading"] for c in made] == ["A", "B", "C"]
    assert made[0]["content"] == "# A\n\none" and made[0]["chunk_type"] == "prose"


def test_what_is_no_heading():
    assert kinds("#A\n") == [("prose", "#A")]
    assert kinds("####### A\n") == [("prose", "####### A")]
    assert kinds("    # A\n") == [("prose", "# A")]


def test_a_ruler_has_three_dashes_and_two_columns():
    assert kinds("a | b\n--- | :---:\n1 | 2\nafter\n") == [("table", "a | b\n--- | :---:\n1 | 2"), ("prose", "after")]
    assert "table" not in dict(kinds("a | b\n- | -\n1 | 2\n"))
    assert "table" not in dict(kinds("a | b\n---\n1 | 2\n"))


def test_lists_go_on_over_indented_lines():
    assert kinds("- a\n  more\n12345678901) b\nc\n") == [("list", "- a\n  more\n12345678901) b"), ("prose", "c")]
    assert kinds("-\u00a0a\n") == [("prose", "-\u00a0a")]


def test_a_fence_closes_on_its_own_kind_and_length():
    text = "````py\n```\n~~~~\n# no heading\n`````\nafter\n"
    assert kinds(text) == [("code", text[: text.index("after")].strip()), ("prose", "after")]


def test_an_open_fence_is_closed():
    (c,) = chunks("~~~\nx = 1\n")
    assert c["content"] == "~~~\nx = 1\n~~~"
    assert set(flags(c)) == {"malformed_fence", "synthetic_closing_fence", "rendered_content_differs"}


def test_long_code_stays_whole_up_to_its_limit():
    (c,) = chunks("```\n" + "x = 1\n" * 14 + "```\n")
    assert len(c["content"]) > PLAIN.size and set(flags(c)) == {"oversized_code", "allowed_oversized_code"}


def test_longer_code_is_wrapped_in_pieces():
    made = chunks("```py\n" + "".join(f"x{i} = {i}\n" for i in range(40)) + "```\n")
    assert len(made) > 1 and all(len(c["content"]) <= PLAIN.size for c in made)
    assert all(c["content"].startswith("```py\n") and c["content"].endswith("\n```") for c in made)
    assert [x for c in made for x in c["content"].split("\n")[1:-1]] == [f"x{i} = {i}" for i in range(40)]
    assert all(flags(c)["split_reason"] == "code_lines" for c in made)


def test_a_long_table_repeats_its_head():
    rows = [f"{i} | {i * i}" for i in range(20)]
    made = chunks("a | b\n--- | ---\n" + "\n".join(rows))
    assert len(made) > 1 and all(c["content"].startswith("a | b\n--- | ---\n") for c in made)
    assert [x for c in made for x in c["content"].split("\n")[2:]] == rows


def test_a_long_list_is_cut_between_lines():
    rows = [f"- item {i}" for i in range(20)]
    made = chunks("\n".join(rows))
    assert len(made) > 1 and [x for c in made for x in c["content"].split("\n")] == rows


def test_sentences_are_packed_and_a_long_one_is_sliced_without_overlap():
    made = chunks('He said "go." She went.\nThen ' + "x" * 150)
    assert made[0]["content"] == 'He said "go." She went.' and {flags(c)["split_reason"] for c in made} == {"sentences"}
    assert all(a["char_end"] <= b["char_start"] for a, b in zip(made, made[1:], strict=False))
    assert {flags(c)["split_reason"] for c in chunks("He said “go.” " + "and so on " * 8)} == {"whitespace"}  # a curly quote ends no sentence


def test_one_sentence_is_cut_at_white_space_and_one_word_by_characters():
    made = chunks("word " * 40)
    assert {flags(c)["split_reason"] for c in made} == {"whitespace"} and all(len(c["content"]) <= PLAIN.size for c in made)
    made = chunks("y" * 130)
    assert [(c["char_start"], c["char_end"]) for c in made] == [(0, 60), (50, 110), (100, 130)]


def test_tiny_chunks_join_a_neighbour_of_their_section():
    o = Options(size=200, overlap=10, least=50, most_code=200)
    text = "# A\n\n" + "long enough to stay alone, whatever comes. " * 2 + "\n\n- tiny\n\n# B\n\n- tiny\n"
    first, second = chunks(text, o)
    assert first["chunk_type"] == "mixed" and first["content"].endswith("- tiny") and "tiny_chunk_merged" in flags(first)
    assert second["heading_path"] == ["B"] and second["chunk_type"] == "list"
    assert len(chunks(text, Options(size=200, overlap=10, least=0, most_code=200))) == 3


def test_a_tiny_first_chunk_takes_the_next_one():
    o = Options(size=200, overlap=10, least=50, most_code=200)
    ((kind, content),) = kinds("- tiny\n\n" + "some words that follow it. " * 3, o)
    assert kind == "mixed" and content.startswith("- tiny")


def test_equal_chunks_are_numbered():
    made = chunks("# A\n\n```\nsame\n```\n\n# A\n\n```\nsame\n```\n")
    assert [c["occurrence"] for c in made] == [0, 1] and len({c["content_hash"] for c in made}) == 1
    assert len({c["chunk_id"] for c in made}) == 2
    assert [c["chunk_id"] for c in made] == [c["chunk_id"] for c in chunks("# A\n\n```\nsame\n```\n\n# A\n\n```\nsame\n```\n")]


_LINE = st.one_of(st.sampled_from(["# A", "## B", "- a", "1. b", "```", "~~~", "a | b", "--- | ---", "", "  in", "One. Two! \"Three?\" four"]), st.text("ab .#|-`é ", max_size=90))


@settings(max_examples=200, deadline=None)
@given(st.lists(_LINE, max_size=25), st.integers(20, 80), st.integers(0, 40))
def test_invariants(lines, size, least):
    text = "\n".join(lines)
    made = chunks(text, Options(size=size, overlap=size // 4, least=least, most_code=size * 2))
    assert [c["chunk_index"] for c in made] == list(range(len(made)))
    assert len({c["chunk_id"] for c in made}) == len(made)
    for c in made:
        assert 0 <= c["char_start"] < c["char_end"] <= len(text)
        assert (c["section_heading"] is None) == (not c["heading_path"])
        if "rendered_content_differs" not in flags(c):
            assert text[c["char_start"] : c["char_end"]] == c["content"]
