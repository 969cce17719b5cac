"""Captures made up for tests and queries: headers, messages and packed payloads as the format has them."""

from __future__ import annotations

import struct

import numpy as np

from tessera.sources import container, metadata


def number(field: int, value: int) -> bytes:
    out = bytearray()
    for v in (field << 3, value % 2**64):
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def nested(field: int, data: bytes) -> bytes:
    tag = number(field, 0)[:-1]
    return bytes([tag[0] | 2]) + tag[1:] + number(0, len(data))[1:] + data


def real(field: int, value: float) -> bytes:
    return bytes([field << 3 | 5]) + struct.pack("<f", value)


def module(camera: int, frame: int, width: int, height: int, offset: int, red: tuple[int, int] = (0, 0), gain: float = 1.0, exposure_ns: int = 10_000_000, temperature_c: int = 30, form: int = metadata.PACKED10) -> bytes:
    m, s = metadata.MODULE, metadata.SURFACE
    surface = nested(s["size"], number(1, width) + number(2, height)) + number(s["format"], form) + number(s["stride"], width * 5 // 4) + number(s["offset"], offset)
    return b"".join(
        (number(m["id"], camera), number(m["frame"], frame), nested(m["surface"], surface), real(m["analog_gain"], gain), real(m["digital_gain"], 1.0), number(m["exposure"], exposure_ns),
         number(m["temperature"], 2 * temperature_c), nested(m["red"], number(1, red[0]) + number(2, red[1])))
    )


def capture(planes: dict[int, np.ndarray], reference: int, focal_length: int = 70, scene: int = 0, device: tuple[int, int] = (7, 9), **settings) -> bytes:
    """A file with one frame of each camera (by number) in one block, and a block of settings."""
    modules, payload = [], b""
    for camera, plane in planes.items():
        modules.append(module(camera, 0, plane.shape[1], plane.shape[0], container.HEADER_SIZE + len(payload), **settings))
        payload += container.pack10(plane)
    h = metadata.HEADER
    head = number(h["device_low"], device[0]) + number(h["device_high"], device[1]) + number(h["focal_length"], focal_length) + number(h["reference"], reference)
    head += b"".join(nested(h["modules"], m) for m in modules)
    return container.framed(metadata.HEADER_KIND, head, payload) + container.framed(metadata.SETTINGS_KIND, number(metadata.SETTINGS["scene"], scene))
