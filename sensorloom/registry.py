"""Modalities, score weights, tasks and the error type of the harmonisation pipeline."""

from __future__ import annotations

# Modality, its columns, weight and interpolation.
MODALITIES = {
    "accelerometer": (("acc_x", "acc_y", "acc_z"), 0.25, "linear"),
    "gyroscope": (("gyro_x", "gyro_y", "gyro_z"), 0.20, "linear"),
    "magnetometer": (("mag_x", "mag_y", "mag_z"), 0.10, "linear"),
    "gps": (("gps_lat", "gps_lon", "gps_speed", "gps_alt"), 0.15, "linear"),
    "barometer": (("pressure",), 0.10, "linear"),
    "heart_rate": (("heart_rate",), 0.10, "ffill"),
    "light": (("light_lux",), 0.05, "linear"),
    "proximity": (("proximity",), 0.05, "ffill"),
}
COMPONENTS = ("distribution", "spectral", "temporal", "missingness", "coverage", "stability")
# Component weights by profile.
WEIGHTS = {
    "default": (0.25, 0.20, 0.20, 0.15, 0.10, 0.10),
    "temporal_spectral": (0.22, 0.24, 0.24, 0.13, 0.07, 0.10),
    "stability_temporal": (0.20, 0.17, 0.24, 0.13, 0.08, 0.18),
    "missingness_stability": (0.21, 0.16, 0.18, 0.22, 0.11, 0.12),
    "distribution_coverage": (0.30, 0.14, 0.14, 0.12, 0.20, 0.10),
    "limited_modality": (0.34, 0.08, 0.10, 0.20, 0.20, 0.08),
}
# Suggested window (seconds), rate (Hz) and weight profile by task.
TASKS = {
    "Human Activity Recognition": (2.5, 50.0, "temporal_spectral"),
    "Gait Analysis": (4.0, 100.0, "temporal_spectral"),
    "Free-living Monitoring": (10.0, 25.0, "stability_temporal"),
    "Driving Behavior": (5.0, 20.0, "stability_temporal"),
    "Health Monitoring": (8.0, 25.0, "missingness_stability"),
    "Environmental Sensing": (30.0, 1.0, "distribution_coverage"),
}
# Below minus these, the mean of a sensor's dominant axis counts as inverted.
AXIS_LIMITS = {"acc": 0.5, "gyro": 0.05, "mag": 1.0}
CHANNELS = tuple(c for columns, _, _ in MODALITIES.values() for c in columns)
INTERPOLATION = {c: how for columns, _, how in MODALITIES.values() for c in columns}


class HarmonizeError(ValueError):
    """A structured failure: ``kind`` is a stable code, ``details`` are for the reader."""

    def __init__(self, kind: str, message: str, **details):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message, self.details = kind, message, details


def modalities_of(columns) -> list[str]:
    have = set(columns)
    return [m for m, (names, _, _) in MODALITIES.items() if have & set(names)]
