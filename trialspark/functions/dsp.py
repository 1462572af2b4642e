"""Numeric kernels on numpy arrays: filters, tapers, spectra. No Spark here."""

from __future__ import annotations

from functools import cache

import numpy as np


def butterworth(low: float | None, high: float | None, fs: float, order: int = 4, kind: str = "bandpass") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter by the bilinear transform of its analogue poles."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if kind == "lowpass":
        w = warp(high if high is not None else low)
        p, z, gain = poles * w, np.zeros(0), w**order
    elif kind == "highpass":
        w = warp(low if low is not None else high)
        p, z, gain = w / poles, np.zeros(order), np.real(1 / np.prod(-poles))
    elif kind == "bandpass":
        a, b = warp(low), warp(high)
        half, w0 = poles * (b - a) / 2, a * b
        root = np.sqrt(half * half - w0)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order), (b - a) ** order
    else:
        raise ValueError(kind)
    t = 2 * fs
    gain = gain * np.real(np.prod(t - z) / np.prod(t - p))
    zd = np.append((t + z) / (t - z), -np.ones(len(p) - len(z)))
    pd = (t + p) / (t - p)
    return np.real(gain * np.poly(zd)), np.real(np.poly(pd))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direct form II transposed along the first axis; ``x`` may have several columns, filtered at once."""
    b, a = b / a[0], a / a[0]
    y = np.empty_like(x, dtype=float)
    s = state.copy()
    for i in range(len(x)):
        y[i] = b[0] * x[i] + s[0]
        s[:-1] = s[1:] + np.multiply.outer(b[1:-1], x[i]) - np.multiply.outer(a[1:-1], y[i])
        s[-1] = b[-1] * x[i] - a[-1] * y[i]
    return y, s


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state under a constant input of one."""
    n = len(a)
    m = np.zeros((n - 1, n - 1))
    m[:, 0] = -a[1:] / a[0]
    m[np.arange(n - 2), np.arange(1, n - 1)] = 1
    return np.linalg.solve(np.eye(n - 1) - m, (b[1:] - a[1:] * b[0]) / a[0])


@cache
def _responses(b: tuple, a: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` samples of the filter's answers to an impulse and to its steady state, as far as they matter."""
    b, a = np.array(b), np.array(a)
    pole = float(np.max(np.abs(np.roots(a)))) if len(a) > 1 else 0.0
    if 0 < pole < 1:
        n = min(n, int(np.ceil(np.log(1e-17) / np.log(pole))) + len(a))
    x = np.zeros((n, 2))
    x[0, 0] = 1
    state = np.stack([np.zeros(len(a) - 1), _steady(b, a)], 1)
    y, _ = lfilter(b, a, x, state)
    return y[:, 0], y[:, 1]


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` from a steady state at its first value on, by convolution with the answers above; columns at once."""
    n = len(x)
    h, z = _responses(tuple(b), tuple(a), 1 << max(6, (n - 1).bit_length()))
    h, z = h[:n], z[:n]
    size = 1 << (n + len(h) - 2).bit_length()
    shape = (-1, *[1] * (x.ndim - 1))
    y = np.fft.irfft(np.fft.rfft(x, size, axis=0) * np.fft.rfft(h, size).reshape(shape), size, axis=0)[:n]
    y[: len(z)] += z.reshape(shape) * x[:1]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, with odd extension at the ends and steady initial states; several columns at once."""
    x = np.asarray(x, float)
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    edge = min(3 * n, len(x) - 1)
    ext = np.concatenate([2 * x[:1] - x[edge:0:-1], x, 2 * x[-1:] - x[-2 : -edge - 2 : -1]]) if edge > 0 else x
    y = _filter(b, a, _filter(b, a, ext)[::-1])[::-1]
    return y[edge : len(y) - edge] if edge > 0 else y


def iir_blocks(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 4096) -> np.ndarray:
    """``filtfilt`` of one long series by blocks filtered side by side, each with a halo in which the start-up dies away."""
    pole = float(np.max(np.abs(np.roots(a)))) if len(a) > 1 else 0.0
    halo = int(np.ceil(np.log(1e-14) / np.log(pole))) + 1 if 0 < pole < 1 else 8
    if len(x) <= block + 2 * halo:
        return filtfilt(b, a, x)
    whole = filtfilt(b, a, x[: block + halo])[:block]
    out = [whole]
    starts = np.arange(block, len(x), block)
    inner = starts[starts + block + halo <= len(x)]
    if len(inner):
        cut = np.stack([x[s - halo : s + block + halo] for s in inner], 1)
        out.append(filtfilt(b, a, cut)[halo : halo + block].T.ravel())
    last = int(inner[-1] + block) if len(inner) else block
    out.append(filtfilt(b, a, x[last - halo :])[halo:])
    return np.concatenate(out)


@cache
def _dpss(n: int, p: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(n)
    w = p / n
    diag = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    m = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    _, v = np.linalg.eigh(m)
    tapers = v[:, ::-1][:, :k].T.copy()
    for j, t in enumerate(tapers):  # even tapers have a positive mean, odd ones start upwards
        if (t.sum() if j % 2 == 0 else t[: n // 2].sum()) < 0:
            tapers[j] = -t
    lag = np.arange(n)
    kernel = np.where(lag == 0, 2 * w, np.sin(2 * np.pi * w * lag) / (np.pi * np.maximum(lag, 1)))
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(np.concatenate([kernel, np.zeros(size - 2 * n + 1), kernel[:0:-1]]))
    ratio = np.einsum("ij,ij->i", tapers, np.fft.irfft(np.fft.rfft(tapers, size) * f, size)[:, :n])
    return tapers, ratio


def dpss(n: int, p: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``k`` discrete prolate spheroidal sequences of length ``n`` and time-bandwidth ``p`` (k x n), and their concentrations."""
    if k < 1 or k > n:
        raise ValueError("1 to n tapers")
    return _dpss(int(n), float(p), int(k))


def taper_parameters(seconds: float, half_bandwidth: float) -> tuple[float, float, int]:
    p = seconds * half_bandwidth
    k = int(np.floor(2 * p - 1))
    if k < 1:
        raise ValueError("time times bandwidth must exceed one")
    return seconds, p, k


def taper_filter(n: int, p: float, k: int, fs: float = 1.0, f0: float = 0.0) -> np.ndarray:
    """Impulse response of the projection on the tapers, shifted to ``f0``."""
    tapers, _ = dpss(n, p, k)
    t = tapers.astype(complex) * np.exp(2j * np.pi * f0 * np.arange(1, n + 1) / fs)
    pr = t.T @ t.conj()
    return np.array([np.trace(pr, offset=m) for m in range(-n + 1, n)]) / n


def mtfilter(x: np.ndarray, seconds: float, p: float, k: int, fs: float = 1.0, f0: float = 0.0, center: bool = True, complex_output: bool = False) -> np.ndarray:
    """A series through the projection filter of its tapers (twice that for bands away from zero)."""
    n = int(np.floor(seconds * fs))
    h = taper_filter(n, p, k, fs, f0)
    if not complex_output and f0 == 0:
        h = h.real
    size = 1 << (len(x) + len(h) - 2).bit_length()
    y = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(h, size))[: len(x) + len(h) - 1]
    y = y[(len(h) - 1) // 2 :][: len(x)] if center else y[: len(x)]
    if f0 > 0 and not complex_output:
        y = 2 * y
    return y if complex_output else y.real


def savgol(x: np.ndarray, window: int, order: int, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    """Least-squares polynomial smoothing or derivative; the ends come from the first and last windows' polynomials."""
    import math

    h = window // 2
    base = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    inv = np.linalg.pinv(base)
    scale = math.factorial(deriv) / delta**deriv
    coef = inv[deriv] * scale
    y = np.convolve(x, coef[::-1], "same").astype(float)
    for part, places in ((x[:window], range(h)), (x[-window:], range(h + 1, window))):
        poly = inv @ part
        for k in places:
            t = k - h
            v = sum(poly[j] * math.factorial(j) / math.factorial(j - deriv) * t ** (j - deriv) for j in range(deriv, order + 1)) / delta**deriv
            y[k if k < h else len(x) - window + k] = v
    return y


def gaussian_smooth(x: np.ndarray, sd: float, fs: float, nstd: float = 3) -> np.ndarray:
    half = int(nstd * sd * fs)
    t = np.arange(-half, half + 1) / fs
    g = np.exp(-(t**2) / (2 * sd * sd))
    return np.convolve(x, g / g.sum(), "same")


def one_sided_fft(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and values of the one-sided transform over n, doubled but for zero frequency."""
    n = len(x)
    v = np.fft.rfft(x) / n
    v[1:] *= 2
    return np.fft.rfftfreq(n, 1 / fs), v


def multitaper_psd(x: np.ndarray, fs: float, p: float = 4.0, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density averaged over tapers by their concentrations."""
    n = len(x)
    k = max(1, int(2 * p - 1))
    tapers, ratio = dpss(n, p, min(k, n))
    nfft = nfft or n
    s = np.abs(np.fft.rfft(tapers * (x - x.mean()), nfft)) ** 2 / fs
    power = (ratio[:, None] * s).sum(0) / ratio.sum()
    power[1 : (nfft + 1) // 2] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), power


def welch_amplitude(x: np.ndarray, fs: float, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude spectrum: root of the median over half-overlapping Hann windows of the scaled power."""
    size = min(len(x), size or len(x) // 4 or len(x))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    seg = np.stack([x[s : s + size] - x[s : s + size].mean() for s in starts])
    pw = np.abs(np.fft.rfft(seg * win)) ** 2 / win.sum() ** 2
    pw[:, 1 : (size + 1) // 2] *= 2
    m = len(seg)
    bias = sum((-1) ** (j + 1) / j for j in range(1, m + 1 if m % 2 else m)) if m > 1 else 1.0
    return np.fft.rfftfreq(size, 1 / fs), np.sqrt(np.median(pw, 0) / bias)


def spectrogram(x: np.ndarray, fs: float, seconds: float, step: float, tapers: np.ndarray | None = None, pad: int = 2, f_max: float | None = None, complex_output: bool = False):
    """Frequencies, window centres and values (frequency x window [x taper]) of tapered windows; power unless complex."""
    n, hop = int(seconds * fs), max(1, int(step * fs))
    if tapers is None:
        tapers = _tukey(n)[None] / np.sqrt((_tukey(n) ** 2).sum())
    nfft = 1 << (n - 1).bit_length() + pad if pad >= 0 else n
    starts = np.arange(0, len(x) - n + 1, hop)
    f = np.fft.rfftfreq(nfft, 1 / fs)
    keep = f <= (f_max if f_max is not None else fs / 2)
    seg = np.stack([x[s : s + n] for s in starts]) if len(starts) else np.zeros((0, n))
    v = np.fft.rfft(seg[:, None, :] * tapers[None], nfft)[:, :, keep]
    v = v if complex_output else (np.abs(v) ** 2).mean(1) / fs
    return f[keep], (starts + n / 2) / fs, np.moveaxis(v, -1, 0)


def _tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    w = np.ones(n)
    m = int(alpha * (n - 1) / 2)
    t = np.arange(m + 1)
    if m:
        w[: m + 1] = 0.5 * (1 + np.cos(np.pi * (2 * t / (alpha * (n - 1)) - 1)))
        w[n - m - 1 :] = w[: m + 1][::-1]
    return w


def multitaper_spectrogram(x, fs: float, seconds: float, half_bandwidth: float, step: float, pad: int = 2, f_max: float | None = None, complex_output: bool = False):
    n = int(seconds * fs)
    _, p, k = taper_parameters(seconds, half_bandwidth)
    tapers, _ = dpss(n, p, k)
    return spectrogram(x, fs, seconds, step, tapers, pad, f_max, complex_output)


def coherence(x: np.ndarray, y: np.ndarray, fs: float, seconds: float, half_bandwidth: float, step: float, pad: int = 2, f_max: float | None = None, imaginary: bool = False):
    """Coherence of two sets of trials (trial x time) by frequency and window, over trials and tapers; and its phase."""
    sx = sy = sxy = 0
    for a, b in zip(x, y, strict=True):
        f, t, va = multitaper_spectrogram(a, fs, seconds, half_bandwidth, step, pad, f_max, True)
        _, _, vb = multitaper_spectrogram(b, fs, seconds, half_bandwidth, step, pad, f_max, True)
        sx, sy, sxy = sx + (np.abs(va) ** 2).sum(-1), sy + (np.abs(vb) ** 2).sum(-1), sxy + (va * vb.conj()).sum(-1)
    c = sxy / np.sqrt(sx * sy)
    return f, t, np.abs(c.imag) if imaginary else np.abs(c) ** 2, np.angle(sxy)


def morlet(x: np.ndarray, freqs, fs: float, fb: float = 1.5, f0: float = 1.0, complex_output: bool = False) -> np.ndarray:
    """Complex Morlet wavelet transform (frequency x time)."""
    out = []
    for f in freqs:
        scale = f0 / f
        half = int(np.ceil(4 * np.sqrt(fb / 2) * scale * fs * 2))
        t = np.arange(-half, half + 1) / fs / scale
        w = np.exp(2j * np.pi * f0 * t - t * t / fb) / np.sqrt(np.pi * fb) / np.sqrt(scale) / fs
        size = 1 << (len(x) + len(w) - 2).bit_length()
        y = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))[half : half + len(x)]
        out.append(y)
    v = np.array(out)
    return v if complex_output else np.abs(v)


def transfer(x: np.ndarray, y: np.ndarray, fs: float, freqs=None) -> tuple[np.ndarray, np.ndarray]:
    """FFT of the output over that of the input, at all or the given frequencies."""
    f, a = one_sided_fft(x, fs)
    _, b = one_sided_fft(y, fs)
    if freqs is not None:
        at = [int(np.argmin(np.abs(f - q))) for q in freqs]
        f, a, b = f[at], a[at], b[at]
    return f, b / a


def phase_aligned_shift(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """``b`` shifted by what maximises its 2-D cross-correlation with ``a`` (NaN as 0); cells shifted in are NaN."""
    x, y = np.nan_to_num(a - np.nanmean(a)), np.nan_to_num(b - np.nanmean(b))
    size = [p + q - 1 for p, q in zip(x.shape, y.shape, strict=True)]
    c = np.real(np.fft.ifft2(np.fft.fft2(x, size) * np.conj(np.fft.fft2(y, size))))
    dy, dx = np.unravel_index(int(np.argmax(c)), c.shape)
    dy, dx = (dy - size[0] if dy > size[0] // 2 else dy), (dx - size[1] if dx > size[1] // 2 else dx)
    out = np.full_like(b, np.nan, dtype=float)
    h, w = b.shape
    out[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)] = b[max(0, -dy) : min(h, h - dy), max(0, -dx) : min(w, w - dx)]
    return out, (int(dy), int(dx))
