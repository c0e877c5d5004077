"""Feeds from a transport that the caller gives, since this engine opens no connections of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: Attempts, seconds of the first pause (twice as long each time), statuses that are tried again below 500.
ATTEMPTS, PAUSE, AGAIN = 3, 1.0, (403, 408, 425, 429)


class FeedError(RuntimeError):
    pass


@dataclass
class Answer:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


def fetch(transport: Callable[[str, dict[str, str], float], Answer], url: str, label: str, agent: str = "vigilframe", deadline: float = 45.0, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The answer of transport(url, headers, seconds). ConnectionError and the statuses that may pass are tried again after a
    growing pause; TimeoutError, the deadline's own, isn't, and neither is a challenge of a firewall."""
    problem = ""
    for k in range(attempts):
        if k:
            sleep(PAUSE * 2 ** (k - 1))
        try:
            answer = transport(url, {"User-Agent": agent}, deadline)
        except TimeoutError as e:
            raise FeedError(f"{label}: no answer in {deadline:g} seconds") from e
        except ConnectionError as e:
            problem = f"{label}: {e}"
            continue
        headers = {k.lower(): v for k, v in answer.headers.items()}
        if "x-amzn-waf-action" in headers:
            raise FeedError(f"{label}: stopped by a firewall ({headers['x-amzn-waf-action']})")
        if 200 <= answer.status < 300:
            return answer
        problem = f"{label}: status {answer.status}"
        if answer.status not in AGAIN and answer.status < 500:
            break
    raise FeedError(problem)
