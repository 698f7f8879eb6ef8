import sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
from corpusmill.llm.secrets import build, mask, spans


def test_spans():
    a = build()
    t = 'x = 1\nkey = "ghp_YYarLdbZbEahb65GdcFlEOis5c8W9DlmiRMo"\npassword = os.environ["A_PASSWORD"]\n'
    (s, e), = spans(t, a)
    assert t[:s].count("\n") == 1 and len(mask(t[s:e])) == e - s
    assert spans(None, a) == [] and spans("", a) == []
