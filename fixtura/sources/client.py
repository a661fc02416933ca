"""Downloads with bounded retries and typed errors; on the driver, before any scan."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable


class ClientError(RuntimeError):
    """A request failed for good."""


class RateLimited(ClientError):
    pass


class NotAuthorised(ClientError):
    pass


class Forbidden(ClientError):
    pass


#: Statuses that have an error of their own.
ERRORS = {401: NotAuthorised, 403: Forbidden, 429: RateLimited}


def _open(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 30, attempts: int = 3, pause: float = 2.0, opener: Callable = _open) -> bytes:
    """The body of a URL; time-outs and broken connections are tried again, statuses are not."""
    for attempt in range(attempts):
        try:
            body = opener(urllib.request.Request(url, headers=headers or {}), timeout)
        except urllib.error.HTTPError as e:
            raise ERRORS.get(e.code, ClientError)(f"{url}: status {e.code}") from e
        except (TimeoutError, ConnectionError, urllib.error.URLError) as e:
            if attempt + 1 == attempts:
                raise ClientError(f"{url}: {e}") from e
            time.sleep(min(10.0, pause * 2**attempt))
        else:
            if not body:
                raise ClientError(f"{url}: empty answer")
            return body
    raise ClientError(url)


class MatchApi:
    """Matches and standings of a competition from a JSON API with a token."""

    def __init__(self, base: str, token: str, opener: Callable = _open) -> None:
        self.base, self.token, self.opener = base.rstrip("/"), token, opener

    def _get(self, path: str, **params: str | None) -> dict:
        given = {k: v for k, v in params.items() if v is not None}
        query = f"?{urllib.parse.urlencode(given)}" if given else ""
        value = json.loads(fetch(f"{self.base}/{path}{query}", {"X-Auth-Token": self.token}, opener=self.opener))
        if not isinstance(value, dict):
            raise ClientError(f"{path}: no object")
        return value

    def matches(self, competition: str, date_from: str | None = None, date_to: str | None = None, status: str | None = None) -> dict:
        return self._get(f"competitions/{competition}/matches", dateFrom=date_from, dateTo=date_to, status=status)

    def standings(self, competition: str) -> dict:
        return self._get(f"competitions/{competition}/standings")
