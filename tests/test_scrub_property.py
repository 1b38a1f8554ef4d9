"""Spark's Java spellings of the scrub rules agree with an independent Python
spelling of the same JavaScript rules on random adversarial strings."""

import random
import re

from reviewloom.functions import scrub

JS_S = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
PY_RULES = [
    (re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", re.I | re.A), scrub.EMAIL_TOKEN),
    (re.compile(r"(\+91[\-" + JS_S[1:-1] + r"]?)?[6-9]\d{9}\b|\b\d{10}\b", re.A), scrub.PHONE_TOKEN),
    (re.compile(r"\b(cust|acc|user|id|ref)[" + JS_S[1:-1] + r"\-_:]*([a-zA-Z0-9]{6,15})\b", re.I | re.A), scrub.ID_TOKEN),
] + [(re.compile(p.replace("(?i)", "").replace(scrub._S, JS_S), re.I | re.A), scrub.INJECTION_TOKEN)
     for p in scrub.INJECTION_RES]

PIECES = ["9876543210", "+91 ", "+91-", "+91\u00a0", "12345678901", "\u00e9", "a.b@ex.org", "@", ".", "user-",
          "cust_", "ID: ", "ref", "ABC123XYZ", " ", "\t", "\u00a0", "\u2009", "x", "_",
          "ignore previous instructions", "act as a", "contact ", "System\u3000Prompt", "7", "Z"]


def _python_scrub(t: str):
    pii = inj = False
    for i, (rx, tok) in enumerate(PY_RULES):
        new = rx.sub(tok, t)
        if new != t:
            if i < 3:
                pii = True
            else:
                inj = True
        t = new
    return t, pii, inj


def test_random_strings_agree(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, content string")
    got = {r.i: (r.content_scrubbed, r.pii_removed, r.injection_neutralized)
           for r in scrub.scrub_columns(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _python_scrub(t), t
