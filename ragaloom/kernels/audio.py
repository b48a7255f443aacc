"""Audio kernels in numpy: decoding, resampling, silence, pitch, onsets and beats, after published algorithms."""

from __future__ import annotations

import io
import wave

import numpy as np


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        samples = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(1), rate


def resampled(audio: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(audio):
        return audio
    n = int(round(len(audio) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(audio)), audio).astype(np.float32)


def valid(audio: np.ndarray, rate: int, seconds: float = 10.0) -> bool:
    """Not empty, long enough, and not silent."""
    return len(audio) > 0 and len(audio) >= round(seconds * rate) and bool(np.abs(audio).max() > 0)


def trimmed(audio: np.ndarray, threshold_db: float = -40.0, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Without leading and trailing frames that are more than the threshold below the loudest."""
    if not len(audio):
        return audio
    starts = np.arange(0, max(1, len(audio) - frame + hop), hop)
    rms = np.array([np.sqrt(np.mean(audio[s : s + frame] ** 2)) if s < len(audio) else 0.0 for s in starts])
    loud = np.flatnonzero(20 * np.log10(np.maximum(rms, 1e-10) / max(rms.max(), 1e-10)) > threshold_db)
    return audio[starts[loud[0]] : starts[loud[-1]] + frame] if len(loud) and rms.max() > 0 else audio[:0]


def _normal_differences(audio: np.ndarray, at: int, frame: int, longest: int) -> tuple[np.ndarray, float]:
    """YIN's cumulative mean normalised difference for lags 0 to ``longest``, and the power of the frame."""
    x = np.zeros(frame + longest)
    part = audio[at : at + frame + longest].astype(np.float64)
    x[: len(part)] = part
    size = 1 << (2 * len(x) - 1).bit_length()
    correlation = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(x[:frame], size)), size)[: longest + 1]
    power = np.concatenate([[0.0], np.cumsum(x**2)])
    difference = power[frame] + power[frame : frame + longest + 1] - power[: longest + 1] - 2 * correlation
    normal = np.ones(longest + 1)
    normal[1:] = difference[1:] * np.arange(1, longest + 1) / np.maximum(np.cumsum(difference[1:]), 1e-12)
    return normal, float(power[frame])


def _between(normal: np.ndarray, lag: int) -> float:
    """The lag of the parabola through a lag and its neighbours."""
    a, b, c = normal[lag - 1], normal[lag], normal[min(lag + 1, len(normal) - 1)]
    bend = a - 2 * b + c
    return lag + (0.5 * (a - c) / bend if abs(bend) > 1e-12 else 0.0)


def pitch_track(audio: np.ndarray, rate: int, low: float = 60.0, high: float = 1000.0, frame: int = 2048, hop: int = 512, threshold: float = 0.15) -> np.ndarray:
    """Frequencies by YIN; 0 where no period is clear. Frames are padded at the end."""
    if not len(audio):
        return np.zeros(0)
    longest = min(int(rate / low) + 1, frame - 2)
    shortest = max(2, int(rate / high))
    out = []
    for at in range(0, len(audio), hop):
        normal, power = _normal_differences(audio, at, frame, longest)
        under = np.flatnonzero(normal[shortest:longest] < threshold)
        if power < 1e-8 or not len(under):
            out.append(0.0)
            continue
        lag = shortest + under[0]
        while lag + 1 < longest and normal[lag + 1] < normal[lag]:
            lag += 1
        out.append(rate / _between(normal, lag))
    return np.asarray(out)


def pitch_candidates(normal: np.ndarray, shortest: int, prior: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, probabilities) of a frame's periods: a threshold of each prior's height takes the first dip under it,
    and where there is none the deepest dip with a hundredth of its weight. ``prior`` is of thresholds 0.01, 0.02, ..."""
    inner = normal[shortest:-1]
    dips = shortest + np.flatnonzero((inner < normal[shortest - 1 : -2]) & (inner <= normal[shortest + 1 :]))
    if not len(dips):
        return np.zeros(0), np.zeros(0)
    under = normal[dips][None, :] < (np.arange(1, len(prior) + 1) / len(prior))[:, None]
    first, some = under.argmax(1), under.any(1)
    weight = np.bincount(first[some], prior[some], minlength=len(dips))
    weight[np.argmin(normal[dips])] += 0.01 * prior[~some].sum()
    keep = weight > 0
    return rate / np.array([_between(normal, d) for d in dips[keep]]), weight[keep]


def probable_pitch_track(audio: np.ndarray, rate: int, low: float = 65.40639132514966, high: float = 2093.004522404789, frame: int = 2048, hop: int = 128, steps: int = 5, switch: float = 0.01) -> np.ndarray:
    """Frequencies by probabilistic YIN, 0 where unvoiced: candidates of every frame by a distribution of thresholds, of
    which a hidden Markov model picks a steady path. The range is C2 to C7; a semitone has ``steps`` places."""
    if not len(audio):
        return np.zeros(0)
    longest, shortest = min(int(rate / low) + 1, frame - 2), max(2, int(rate / high))
    t = np.arange(1, 101) / 100
    prior = t * (1 - t) ** 17
    prior /= prior.sum()
    places = int(np.ceil(12 * steps * np.log2(high / low))) + 1
    reach = max(1, int(round(steps * 35.92 * 12 * hop / rate)))  # pitch moves by 35.92 octaves a second at most
    slope = np.arange(1, reach + 2, dtype=float)
    moves = np.log(np.concatenate([slope, slope[-2::-1]]) / (reach + 1) ** 2)
    stay, change, floor = np.log(1 - switch), np.log(switch), 1e-12
    score, back, heard = None, [], []
    for at in range(0, len(audio), hop):
        normal, power = _normal_differences(audio, at, frame, longest)
        hz, weight = pitch_candidates(normal, shortest, prior, rate) if power >= 1e-8 else (np.zeros(0), np.zeros(0))
        fine = (hz >= low) & (hz <= high)
        voiced, exact = np.zeros(places), np.zeros(places)
        best = np.zeros(places)
        for f, w in zip(hz[fine], weight[fine], strict=True):
            i = int(round(12 * steps * np.log2(f / low)))
            voiced[i] += w
            if w > best[i]:
                best[i], exact[i] = w, f
        heard.append(exact)
        silent = max(1 - voiced.sum(), floor) / places
        now = np.log(np.concatenate([voiced, np.full(places, silent)]) + floor)
        if score is None:
            score = now - np.log(2 * places)
            continue
        halves = []
        for half in (score[:places], score[places:]):
            wide = np.lib.stride_tricks.sliding_window_view(np.pad(half, reach, constant_values=-np.inf), 2 * reach + 1) + moves
            to = wide.argmax(1)
            halves.append((wide[np.arange(places), to], to + np.arange(places) - reach))
        (a, from_a), (b, from_b) = halves
        into_voiced, into_silent = a + stay >= b + change, b + stay >= a + change
        back.append(np.concatenate([np.where(into_voiced, from_a, from_b + places), np.where(into_silent, from_b + places, from_a)]))
        score = now + np.concatenate([np.where(into_voiced, a + stay, b + change), np.where(into_silent, b + stay, a + change)])
    state = int(np.argmax(score))
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    out = []
    for s, exact in zip(reversed(path), heard, strict=True):
        out.append(0.0 if s >= places else exact[s] or low * 2 ** (s / (12 * steps)))
    return np.asarray(out)


def onset_strength(audio: np.ndarray, frame: int = 1024, hop: int = 512) -> np.ndarray:
    """Spectral flux: the summed rise of log magnitudes from frame to frame."""
    if len(audio) < frame:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(audio, frame)[::hop] * np.hanning(frame)
    spectrum = np.log1p(100 * np.abs(np.fft.rfft(frames, axis=1)))
    return np.concatenate([[0.0], np.maximum(np.diff(spectrum, axis=0), 0).sum(1)])


def onsets(audio: np.ndarray, rate: int, hop: int = 512) -> np.ndarray:
    """Times of local peaks of the flux above its surroundings."""
    flux = onset_strength(audio, hop=hop)
    peaks = [i for i in range(1, len(flux) - 1) if flux[i] >= flux[max(0, i - 3) : i + 4].max() and flux[i] > flux[max(0, i - 20) : i + 21].mean() + 0.5 * flux.std()]
    return np.asarray(peaks, float) * hop / rate


def beats(audio: np.ndarray, rate: int, hop: int = 512, tightness: float = 100.0) -> np.ndarray:
    """Beat times by dynamic programming: strong onsets at steps close to the period of the flux."""
    flux = onset_strength(audio, hop=hop)
    if len(flux) < 8 or flux.std() == 0:
        return np.zeros(0)
    flux = (flux - flux.mean()) / flux.std()
    fps = rate / hop
    correlation = np.correlate(flux, flux, "full")[len(flux) - 1 :]
    lags = np.arange(max(1, int(fps * 60 / 240)), min(len(flux) - 1, int(fps * 60 / 40)) + 1)
    if not len(lags):
        return np.zeros(0)
    period = lags[np.argmax(correlation[lags] * np.exp(-0.5 * np.log2(lags / (fps * 0.5)) ** 2))]
    score, back = flux.copy(), np.full(len(flux), -1)
    for i in range(period // 2, len(flux)):
        before = np.arange(max(0, i - 2 * period), max(0, i - period // 2))
        if len(before):
            worth = score[before] - tightness * np.log((i - before) / period) ** 2
            if worth.max() > 0:
                score[i], back[i] = flux[i] + worth.max(), before[np.argmax(worth)]
    at, found = int(np.argmax(score)), []
    while at >= 0:
        found.append(at)
        at = int(back[at])
    return np.asarray(found[::-1], float) * hop / rate
