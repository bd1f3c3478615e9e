"""Documents with all the awkward cases: null ids and texts, empty, long, repeated rows, clashing extra columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, node string, _h string, "
          "d string, value string, kind string")
WORDS = "the of and to in is that for it as with on by this are be from at".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        w = rnd.choice(WORDS) if rnd.random() < 0.4 else "".join(rnd.choice(["er", "th", "on", "an", "re", "he"]) for _ in range(3))
        out.append(w + ("." if k % 12 == 11 else ""))
    return " ".join(out)


BASE = prose(1, 120)
NEAR = " ".join(w if k not in (20, 80) else "changed" for k, w in enumerate(BASE.split()))
TEXTS = [
    (0, BASE), (1, NEAR), (2, BASE), (3, prose(2, 90)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"),
    (8, "Two Words"), (9, prose(3, 6000)), (10, "naïve 東京 Ünï ## %% | " + prose(4, 60)), (3, prose(2, 90)), (3, prose(5, 90)),
    (None, prose(6, 70)), (None, BASE), (None, None), (11, "line one here\nline one here\n\nline two\n" * 30),
    (12, "a\x1cb\x00c <|endoftext|> d\xa0e"), (13, "12345 678 !!! ???"),
]
