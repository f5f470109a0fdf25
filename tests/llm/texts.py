"""A small corpus with the awkward cases, and plain models of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, hit_id long, label_id long, unit string, bands string, member long"
_rng = random.Random(11)
_WORDS = ["the", "Of", "and", "ou", "tion", "é", "straße", "A1", "b-2", "it's", "###", "x|y", "niño"]


def prose(n: int, rng: random.Random = _rng) -> str:
    return " ".join(rng.choice(_WORDS) + rng.choice(["", "", "", ".", ","]) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(6000)
PASSAGE = prose(70)
TEXTS = [None, "", "   \n\t ", "one", "one two three four", "one two three four", prose(30), prose(300), PASSAGE, prose(20) + " " + PASSAGE + " " + prose(25), prose(40) + "\n" + PASSAGE, LONG, LONG + " tail words", " ".join(LONG.split()[100:5900]), "same line\nsame line\nother\nsame line", "  odd\x1cspace\x85here \xa0 and 　 so", "x" * 3000, "é" * 50 + " 漢字 😀"]
TEXTS += [prose(200)] * 3
near = prose(200).split()
for k in range(6):
    TEXTS.append(" ".join(near[:k] + [f"edit{k}"] + near[k + 1 :]))


def rows(texts=TEXTS):
    """Rows with extra columns whose names the operators use inside."""
    return [(i * 7 + 3, t, "en" if i % 2 else None, "s", None, 1, 2, 3, "u", "b", 4) for i, t in enumerate(texts)]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
