"""Small corpora with odd rows: nulls, empty and long texts, repeats, ties."""

import random

SYLLABLES = ["the", "an", "on", "er", "tion", "ing", "re", "ha", "wh", "st", "ou", "é", "ñó"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n=60, seed=1):
    """(doc_id, text) rows, among them near copies, exact copies and odd texts."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        text = prose(rng, rng.choice([3, 8, 20, 60, 150]))
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 4])):
            ws = text.split()
            for _ in range(rng.randint(0, max(1, len(ws) // 12))):
                ws[rng.randrange(len(ws))] = prose(rng, 1)
            rows.append(" ".join(ws))
    odd = [None, "", " \t\n ", "one", "ONE", "One two", "one two", "a  b   c \n\n  d ", "x" * 5000, "日本語 テキスト 🙂 ok",
           "tabs\tand\r\nlines\x0b", "\x1c odd \x85 spaces here", prose(rng, 4000)]
    rows += odd
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return out + [out[0], out[5]] + [(None, "a row without id"), (None, None)]
