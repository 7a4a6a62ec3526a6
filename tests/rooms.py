"""Synthetic captures: a depth camera turned about inside rooms of known size."""

import os

import numpy as np

from plumbline.sources import png

W, H, FOCAL, CX, CY = 256, 192, 213.05, 127.4, 95.7
FLOOR = -1.4


def camera(yaw, pitch):
    """Camera axes in the world: x right, y up, z forward."""
    cy, sy, cp, sp = np.cos(yaw), np.sin(yaw), np.cos(pitch), np.sin(pitch)
    forward = np.array([cp * sy, sp, cp * cy])
    right = np.array([cy, 0.0, -sy])
    return np.stack([right, np.cross(forward, right), forward], axis=1)


def quaternion(r):
    w = np.sqrt(max(0.0, 1 + np.trace(r))) / 2
    if w > 1e-6:
        return (r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w), w
    k = int(np.argmax(np.diag(r)))
    i, j = (k + 1) % 3, (k + 2) % 3
    s = np.sqrt(max(1e-12, 1 + r[k, k] - r[i, i] - r[j, j])) * 2
    q = np.zeros(4)
    q[k], q[i], q[j], q[3] = s / 4, (r[i, k] + r[k, i]) / s, (r[j, k] + r[k, j]) / s, (r[j, i] - r[i, j]) / s
    return tuple(q)


def depth(origin, r, walls, height, rng):
    """Depth picture of one view, in metres along the camera's axis; 0 beyond 5 m."""
    v, u = np.indices((H, W))
    rays = np.stack([(u - CX) / FOCAL, (v - CY) / FOCAL, np.ones_like(u, float)], -1) @ r.T
    best = np.full((H, W), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for y in [FLOOR] + ([FLOOR + height] if height else []):
            t = (y - origin[1]) / rays[..., 1]
            best = np.where((t > 0) & (t < best), t, best)
        for ax, az, bx, bz in walls:
            ex, ez = bx - ax, bz - az
            det = rays[..., 0] * -ez + ex * rays[..., 2]
            t = ((ax - origin[0]) * -ez + ex * (az - origin[2])) / det
            s = (rays[..., 0] * (az - origin[2]) - rays[..., 2] * (ax - origin[0])) / det
            y = origin[1] + t * rays[..., 1]
            best = np.where((t > 0) & (t < best) & (s >= 0) & (s <= 1) & (y <= FLOOR + (height or 2.6)), t, best)
    z = np.where(np.isfinite(best), best + rng.normal(0, 1, best.shape) * (0.008 + 0.002 * np.minimum(best, 9)), 0)
    return np.where((z > 0) & (z < 5), z, 0)


def write(root, walls, path, height=2.6, yaws=8, pitches=(-25, 10, 35), seed=0):
    """A capture folder as a depth camera would leave it."""
    rng = np.random.default_rng(seed)
    os.makedirs(f"{root}/depth")
    os.makedirs(f"{root}/confidence")
    lines, i = ["timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy"], 0
    for x, z in path:
        for yaw in np.arange(yaws) * 2 * np.pi / yaws:
            for pitch in np.radians(pitches):
                r = camera(yaw, pitch)
                picture = depth(np.array([x, 0.0, z]), r, walls, height, rng)
                name = f"{i:06d}"
                open(f"{root}/depth/{name}.png", "wb").write(png.encode(np.round(picture * 1000).astype(np.uint16)))
                open(f"{root}/confidence/{name}.png", "wb").write(png.encode(np.where(picture > 0, 2, 0).astype(np.uint8)))
                lines.append(", ".join([f"{i * 0.05}", name, *[repr(float(v)) for v in (x, 0.0, z, *quaternion(r), FOCAL, FOCAL, CX, CY)]]))
                i += 1
    open(f"{root}/odometry.csv", "w").write("\n".join(lines) + "\n")


def loop(corners):
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
