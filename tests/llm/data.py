"""Small tables with the awkward cases that every operator must take."""

import random

WORDS = "the of and to amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh notch orbit plaza quarry ridge".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, spans string, hash int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_texts():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    shared = prose(rng, 35)
    texts = [None, "", " \t\n ", "one", "two words", "a " * 50, "x" * 5000, prose(rng, 6000), base[0], base[0], base[0].upper(), base[1] + ".", base[1]]
    texts += [f"{prose(rng, 10)} {shared} {prose(rng, 10)}" for _ in range(4)]
    texts += [base[2] + "\n" + base[3] + "\n\n" + base[3][:-1], base[3] + "\n" + base[4].replace("the", "thE", 1), base[4], "é" + base[5], "É" + base[5], "Ünïcode ▁ mark \x1c   ½ ① 漢字 🙂 end\r\n\x0b\x0c."]
    texts += ["mail a.b+c@d-e.fg.h, or x@y.z@q.r; 10.0.0.255 and 1.2.3.4.5.6.7.8 not 1.2.3.256", "card 4111 1111-1111 1111 or 4111111111111112; +1 (555) 010-9999 and +12", "<|endoftext|> inside <|endoftext|>"]
    return texts


def rows(texts):
    return [(i * 3 % 101 if i != 4 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), i, "k", "s", i) for i, t in enumerate(texts)]


def frame(spark, texts=None):
    return spark.createDataFrame(rows(awkward_texts() if texts is None else texts), SCHEMA)


def saved(spark, folder, df):
    """Operators read stored tables; so do the tests."""
    df.write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))
