"""Fixed facts of the data model: sensors, physics groups, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sensor names and their device numbers.
SENSORS = {
    "IMU_ACC_X": 0, "IMU_ACC_Y": 1, "IMU_ACC_Z": 2, "SPEED_X": 3, "SPEED_Y": 4, "SPEED_Z": 5, "DRAG": 6,
    "GPS_X": 7, "GPS_Y": 8, "GPS_Z": 9, "GEAR": 10, "ENGINE_RPM": 11, "YAW": 13, "PITCH": 14, "ROLL": 15,
    "STEER": 31, "THROTTLE": 32, "BRAKE": 33, "REVERSE": 34, "HAND_BRAKE": 35, "YAW_RATE": 36,
    "PITCH_RATE": 37, "ROLL_RATE": 38, "FUEL": 42, "CO2_EMISSION": 43, "ODOMETER": 54,
}
EGO_DEVICE = 16
#: Devices whose vectors are relative to the ego vehicle, and road users that report themselves.
RELATIVE_DEVICES = (20, 21, 22, 23)
ETSI_DEVICES = (26, 27, 28)
WINDOW = 30
SAMPLE_HZ = 10.0

RUN_CONTEXT = """
id string, description string, sigs array<bigint>,
vehicles array<struct<body: struct<mass: double>,
  sensors: array<struct<kind: string, readings: array<struct<measurement: string, unit: string, t0: string, tf: string, dev: string>>>>,
  actuation: array<struct<measurement: string, unit: string, t0: string, tf: string, dev: string>>,
  telemetry: array<struct<measurement: string, unit: string, t0: string, tf: string, dev: string>>,
  motion_vectors: array<struct<measurement: string, unit: string, t0: string, tf: string, dev: string, available: boolean>>>>,
environment struct<simulatorSettings: struct<map_friction: double>,
  location: struct<map_features: map<string, array<struct<
    start: struct<latitude: double, longitude: double, altitude: double>,
    end: struct<latitude: double, longitude: double, altitude: double>,
    latitude: double, longitude: double, altitude: double,
    rx: double, ry: double, rz: double, w: double, r: double, l: double, class: string>>>>>
"""
SERIES = "series array<struct<dev: bigint, value: string, x: double, y: double, z: double, timestamp: bigint>>"


#: Mass and friction of each group of twenty runs, in order.
SETTINGS = [
    (8300, 1.0), (10900, 1.0), (13500, 1.0), (13500, 1.0), (10900, 1.0), (8300, 0.75),
    (10900, 0.75), (13500, 0.75), (13500, 0.5), (10900, 0.5), (8300, 0.5),
]
GROUPS = [(f"group_{i + 1}", 20 * i + 1, 20 * i + 20, m, f) for i, (m, f) in enumerate(SETTINGS)]


def physics_groups(spark: SparkSession) -> DataFrame:
    """The eleven groups of twenty runs: lo and hi run number, vehicle mass, road friction."""
    return spark.createDataFrame(GROUPS, "group string, lo int, hi int, mass int, friction double")
