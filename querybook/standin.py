"""A stand-in for a hosted model: its answer is a formula of the prompt's length.
"""

from __future__ import annotations

from .inputs import quoted

# The openings by which the stand-in tells prompts apart.
SENTIMENT_OPENING = "Analyze the sentiment"
TOPIC_OPENING = "Extract key topics"
PACKED_OPENING = "Process the following items"


def _standin():
    openings = (SENTIMENT_OPENING, TOPIC_OPENING, PACKED_OPENING)

    def sentiment(n: int) -> str:
        label = ("positive", "negative", "neutral")[n % 3]
        confidence = f"{n % 11 // 10}.{n % 11 % 10}"
        return f'{{"sentiment": "{label}", "confidence": {confidence}, "key_emotions": ["e{n % 8}"]}}'

    def client(prompt: str) -> dict:
        n = len(prompt)
        if prompt.startswith(openings[0]):
            content = sentiment(n)
        elif prompt.startswith(openings[1]):
            content = (
                f'{{"main_topics": ["t{n % 9}", "t{n % 4}"], '
                f'"issues": ["i{n % 6}"], "praise": ["p{n % 5}"]}}'
            )
        elif prompt.startswith(openings[2]):
            # From no answer at all up to five: some arrays are short on purpose.
            content = "[" + ", ".join(sentiment(n + i) for i in range(n % 6)) + "]"
        else:
            content = f"Report on {n} characters"
        return {"content": content, "tokens_used": n % 1000}

    return lambda: client


def _packing_standin():
    """The same, and each item of a packed request is answered as a prompt of its own.

    Some requests are a pack short of their last answer.
    """
    single, packed = _standin(), PACKED_OPENING
    item = rf"(?m)^\d+\. (?={SENTIMENT_OPENING}|{TOPIC_OPENING})"

    def build():
        import re

        client = single()

        def answer(prompt: str) -> dict:
            if not prompt.startswith(packed):
                return client(prompt)
            items = [text.removesuffix("\n") for text in re.split(item, prompt)[1:]]
            if len(prompt) % 3 == 0:
                items = items[:-1]
            return {"content": "[" + ", ".join(client(text)["content"] for text in items) + "]"}

        return answer

    return build


def _list_standin(refused: int):
    """Lists of prompts; a call that holds a prompt of certain lengths fails."""
    single = _standin()

    def build():
        client = single()

        def answers(prompts: list[str]) -> list[dict]:
            if any(len(prompt) % refused == 0 for prompt in prompts):
                raise ValueError("refused")
            return [client(prompt) for prompt in prompts]

        return answers

    return build


#: Lengths of prompts that the list client refuses are multiples of this.
REFUSED = 50
packing_client = _packing_standin()
list_client = _list_standin(REFUSED)

#: Client factory. It is built inside a function, so that it travels to the tasks by
#: value and they need not find this module.
standin_client = _standin()


# ---- the same formulas for the check


def sentiment_label_sql(n: str) -> str:
    return f"case ({n}) % 3 when 0 then 'positive' when 1 then 'negative' else 'neutral' end"


def confidence_sql(n: str) -> str:
    return f"(({n}) % 11) / cast(10 as double)"


def emotion_sql(n: str) -> str:
    return f"concat('e', ({n}) % 8)"


def rendered_sql(template: str, **columns: str) -> str:
    """SQL that fills a template: variable=SQL expression."""
    text = quoted(template)
    for variable, expression in columns.items():
        text = text.replace("{" + variable + "}", f"' || {expression} || '")
    return f"({text})"
