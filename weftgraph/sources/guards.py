"""What may be fetched or opened: checks of URLs and of paths."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

#: Addresses under which clouds tell their machines secrets.
METADATA = frozenset(("169.254.169.254", "metadata.google.internal", "metadata.internal", "metadata", "instance-data"))


class Refused(ValueError):
    pass


def blocked_ip(address: str) -> bool:
    """Whether an address is private, local, shared by many, or set aside for documents."""
    ip = ipaddress.ip_address(address)
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip.is_multicast or (ip.version == 4 and ip == ipaddress.ip_address("255.255.255.255"))


def _addresses(host: str, port: int) -> list[str]:
    try:
        return [str(x[4][0]).split("%")[0] for x in socket.getaddrinfo(host, port, proto=socket.IPPROTO_TCP)]
    except OSError:
        return []  # an unknown host can't be reached anyway


def check_url(url: str, resolve: Callable[[str, int], list[str]] = _addresses) -> tuple[str, str]:
    """(host, path with query) of a URL that may be fetched; raises Refused for other schemes, metadata hosts and inner addresses."""
    scheme, found, rest = url.partition("://")
    if not found:
        raise Refused(f"no scheme in {url!r}")
    if scheme.lower() not in ("http", "https"):
        raise Refused(f"only http and https may be fetched, not {scheme!r}")
    try:
        parts = urlsplit(f"{scheme.lower()}://{rest}")
        host, port = parts.hostname or "", parts.port
    except ValueError as e:
        raise Refused(f"malformed host in {url!r}") from e
    if not host:
        raise Refused(f"no host in {url!r}")
    if host.lower() in METADATA:
        raise Refused(f"{host!r} is a metadata endpoint")
    try:
        found_ips = [str(ipaddress.ip_address(host))]
    except ValueError:
        found_ips = resolve(host, port or (443 if scheme.lower() == "https" else 80))
    for ip in found_ips:
        if blocked_ip(ip):
            raise Refused(f"{host!r} leads to the inner address {ip}")
    return host, parts.path + (f"?{parts.query}" if parts.query else "")


def inside(path: str | Path, base: str | Path) -> Path:
    """The real path of a file within the folder `base`; raises Refused if it leads out, by .. or by links, FileNotFoundError if it or the folder is missing."""
    base = Path(base)
    if not base.is_dir():
        raise FileNotFoundError(f"{base} doesn't exist; build the graph first")
    base, found = base.resolve(), Path(path).resolve()
    if not found.is_relative_to(base):
        raise Refused(f"{found} lies outside {base}")
    if not found.exists():
        raise FileNotFoundError(str(found))
    return found
