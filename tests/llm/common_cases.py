"""Documents with every awkward case that the operators must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string, fp string"


def awkward() -> list[tuple]:
    words = "the old river runs past seven quiet mills before it meets the grey sea near a small town of stone".split()
    base = " ".join(words[i * 7 % len(words)] + (str(i) if i % 5 == 0 else "") for i in range(120))
    near = base.replace("mills", "barns", 1)
    long = " ".join(f"word{i % 977} river{i % 31}" for i in range(20_000))
    texts = [
        base, base, near, "Vorwort: " + base + " und so weiter", None, "", "   \n\t ", "one", "one two", "one two three", "ONE two three",
        "x" * 5000, long, long + " end", "a a a a a a a a a a a a a a a a a a a a", "12345 !!! ***", "été à la plage, où l’on dort — “bien”", "漢字 かな 한글 ٣ Ⅷ ½",
        "<|endoftext|> in a text <|endoftext|>", "mail me@example.com or +49 170 1234567 please", "tail  of   spaces \n\n and\r\nlines ", "#hash *star $dollar % & | < >", "\x00 zero byte",
    ]
    rows = [(i, t, None if i % 6 == 5 else "en" if i % 2 else "de", "s", 0, "s", "b", "f") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "s", 0, "s", "b", "f")]
