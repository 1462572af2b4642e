import numpy as np
import pytest

from trialspark.functions import dsp


def response(b, a, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize(("kind", "low", "high", "edges", "inside", "outside"), [("lowpass", None, 30, [30], 1, 300), ("highpass", 30, None, [30], 300, 1), ("bandpass", 30, 80, [30, 80], 49, 300)])
def test_butterworth(kind, low, high, edges, inside, outside):
    b, a = dsp.butterworth(low, high, 1000.0, 4, kind)
    for e in edges:
        assert abs(response(b, a, e, 1000.0) - 2**-0.5) < 1e-6
    assert response(b, a, inside, 1000.0) > 0.99 and response(b, a, outside, 1000.0) < 0.01


def test_filtfilt_keeps_lines_and_phase():
    b, a = dsp.butterworth(None, 30, 1000.0, 4, "lowpass")
    x = np.linspace(0, 1, 400)
    assert np.allclose(dsp.filtfilt(b, a, np.ones(400)), 1) and np.abs(dsp.filtfilt(b, a, x) - x).max() < 0.005
    long = np.random.default_rng(0).normal(size=20000)
    assert np.allclose(dsp.iir_blocks(b, a, long), dsp.filtfilt(b, a, long), atol=1e-8)


def test_tapers():
    t, ratio = dsp.dpss(200, 4, 7)
    assert np.allclose(t @ t.T, np.eye(7), atol=1e-9) and ratio[0] > 0.999999 and (np.diff(ratio) < 1e-12).all() and ratio[6] > 0.7
    with pytest.raises(ValueError, match="exceed one"):
        dsp.taper_parameters(0.1, 5)


def test_mtfilter_passes_its_band():
    fs = 1000.0
    t = np.arange(2000) / fs
    for f, gain in ((50, 1), (200, 0)):
        y = dsp.mtfilter(np.cos(2 * np.pi * f * t), 0.5, 0.5 * 10, 9, fs, 50)
        assert abs(np.abs(y[600:1400]).max() - gain) < 0.15


def test_savgol_is_exact_on_polynomials():
    t = np.arange(40) * 0.1
    x = 1 + 2 * t + 3 * t**2 - t**3
    assert np.allclose(dsp.savgol(x, 9, 3), x) and np.allclose(dsp.savgol(x, 9, 3, 1, 0.1), 2 + 6 * t - 3 * t**2)


def test_spectra_find_a_tone():
    fs = 500.0
    t = np.arange(2000) / fs
    x = 3 * np.cos(2 * np.pi * 40 * t)
    f, v = dsp.one_sided_fft(x, fs)
    assert f[np.abs(v).argmax()] == 40 and abs(np.abs(v).max() - 3) < 1e-9
    for f, p in (dsp.multitaper_psd(x, fs), dsp.welch_amplitude(x, fs, 500)):
        assert abs(f[np.argmax(p)] - 40) < 1.5
    f, p = dsp.multitaper_psd(np.random.default_rng(0).normal(size=4000), fs)
    assert abs(p.sum() * (f[1] - f[0]) - 1) < 0.1  # white noise of variance one
    f, w, s = dsp.multitaper_spectrogram(x, fs, 0.5, 8, 0.25)
    assert s.shape == (len(f), len(w)) and abs(f[s[:, 3].argmax()] - 40) < 8
    m = dsp.morlet(x, [20, 40, 80], fs)
    assert m[:, 1000].argmax() == 1


def test_coherence_and_transfer():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 500))
    f, t, c, _ = dsp.coherence(x, 2 * x, 500.0, 0.5, 8, 0.25)
    assert np.allclose(c, 1)
    _, _, c, _ = dsp.coherence(x, rng.normal(size=x.shape), 500.0, 0.5, 8, 0.25)
    assert c.mean() < 0.05
    f, h = dsp.transfer(x[0], 3 * x[0], 500.0, [10, 20])
    assert np.allclose(h, 3)


def test_maps_are_aligned():
    a = np.zeros((8, 8))
    a[2:5, 3:6] = np.arange(9).reshape(3, 3)
    moved, shift = dsp.phase_aligned_shift(a, np.roll(a, (2, -1), (0, 1)))
    assert shift == (-2, 1) and np.nanmax(np.abs(moved[2:5, 3:6] - a[2:5, 3:6])) == 0
