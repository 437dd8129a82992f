"""Codes, names and physical constants the results depend on."""

# --- fixed values -----------------------------------------------------------------
SEMANTIC_CLASSES = [
    "unknown", "flat_regolith", "rough_regolith", "crater_floor", "crater_wall", "crater_rim",
    "rock_field", "berm", "trench", "compacted_surface", "disturbed_regolith", "unsafe_slope",
]
ELEVATION_SOURCES = ["synthetic", "measured", "measured_plus_synthetic"]
OPERATION_KINDS = [
    "raise", "lower", "smooth", "flatten", "slope", "noise", "semantic_paint", "crater_stamp",
    "trench", "berm", "ramp", "pad", "spoil_pile", "wheel_track", "polygonal_cut", "polygonal_fill",
]
# Class painted over the footprint of a construction edit.
FOOTPRINT_CLASS = {
    "ramp": "compacted_surface", "pad": "compacted_surface", "spoil_pile": "berm",
    "wheel_track": "disturbed_regolith", "polygonal_cut": "trench", "polygonal_fill": "berm",
}
# Class recorded on the construction feature of an edit.
FEATURE_CLASS = {"trench": "trench", "berm": "berm", **FOOTPRINT_CLASS}
FEATURE_KINDS = [
    "berm", "trench", "ramp", "pad", "excavation", "spoil_pile", "graded_slope", "wheel_track",
    "polygonal_cut", "polygonal_fill",
]
BODY_RADIUS_M = 1_737_400.0
REPOSE_ANGLE_DEG = 35.0
SPARSE_SAMPLE_CAP = 65_536
DELTA_WINDOW = 256
BULK_DENSITY_KG_M3 = 1660.0
# ----------------------------------------------------------------------------------

CODE = {name: i for i, name in enumerate(SEMANTIC_CLASSES)}
