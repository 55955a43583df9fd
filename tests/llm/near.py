"""Texts in families of near copies, and their groups by comparing all pairs."""

import random


def brute_groups(texts, least=0.8):
    sets = {}
    for k, text in texts.items():
        words = (text or "").lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    group = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def near_texts():
    """Families of texts whose members differ in words here and there, around a similarity of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 300))]
        for edits in range(6):
            words = list(base)
            for _ in range(edits * len(base) // 100 + (edits > 0)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return dict(enumerate(texts))
