"""Main text in several places of a page, none of which may be lost."""

from asof_factors.llm import html_extract

A = ["First text, with commas, and more of it to read.", "Second text, again with commas, and some more."]
B = ["Third text, with commas, in the next container.", "Fourth text, with commas, and the end of it."]


def test_sibling_containers():
    page = f"<body><nav><a>Home</a></nav><div><p>{A[0] * 2}</p><p>{A[1]}</p></div><div><p>{B[0]}</p><p>{B[1]}</p></div><footer>x</footer></body>"
    assert html_extract.extract(page) == "\n".join([A[0] * 2, A[1], *B])


def test_main_text_beside_an_article():
    body = "".join(f"<p>{x}</p>" for x in A * 3)
    page = f"<body><nav><a>Home</a></nav><main><p>{B[0]}</p><article><h1>T</h1>{body}</article><p>{B[1]}</p></main></body>"
    assert html_extract.extract(page) == "\n".join([B[0], "T", *A * 3, B[1]])
    page = f"<body><article><h1>T</h1>{body}</article><div><p>{B[0]}</p><p>{B[1]}</p></div><div class='sidebar'><p>{B[0]}</p></div></body>"
    assert html_extract.extract(page) == "\n".join(["T", *A * 3, *B])
