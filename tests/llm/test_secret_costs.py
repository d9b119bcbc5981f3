"""What a value costs to find out."""

from carelake.llm import secrets as S


def test_equal_values_of_a_text_are_costed_once(monkeypatch):
    asked, was = [], S.guess_cost
    monkeypatch.setattr(S, "guess_cost", lambda value, **rest: asked.append(value) or was(value, **rest))
    text = "pwd: Xk9$mQ2!vT7# login: monday2021 " * 50
    spans = S.find_secrets(text, S.word_ranks(S.default_vocabulary()))
    assert sorted(asked) == ["Xk9$mQ2!vT7#", "monday2021"] and len(spans) == 50
