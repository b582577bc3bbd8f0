"""Skip edges of the personal data field: distant equal tokens are linked, whatever stands between them."""

from rowmill.llm import pii


def edges(text):
    nodes = pii.nodes_of(text)
    return nodes.chain, nodes.same, nodes.shape


def test_equal_tokens_with_nothing_between():
    assert edges("card 4111111111111111 was used and then again later 4111111111111111") == ([], [(0, 1)], [])
    # the chain links neighbours, so they need no other edge
    assert edges("4111111111111111 4111111111111111") == ([(0, 1)], [], [])
    # three mentions: each is linked with the one before it
    assert edges("call 555-0101 or write, then call 555-0101 and much later 555-0101")[1] == [(0, 1), (1, 2)]


def test_shapes_and_signs():
    assert edges("at 10.0.0.1 there was once a host 10.0.0.2")[2] == [(0, 1)]
    assert edges("dial +14155550100 abroad but at home 14155550100")[1] == [(0, 1)]
