"""Units and other fixed values. Each must equal the published figure for results to agree."""

# fixed values: areas and lengths
SQM_TO_SQFT = 10.7639104
M_TO_FT = 3.2808399
ACRE_TO_SQFT = 43560.0
GUNTHA_TO_SQFT = 1089.0
HECTARE_TO_SQM = 10000.0
HECTARE_TO_SQFT_CALIBRATION = 107639.1
HECTARE_TO_SQFT_WIZARD = 107639.0
SQM_TO_SQFT_CALIBRATION = 10.7639
SQFT_TO_SQM_SCORER = 0.09290304
SQFT_TO_SQM_DISPLAY = 0.092903
METERS_PER_DEGREE_LAT = 111139.0
FEET_PER_METER_CALIBRATION = 3.28084

# fixed values: states
PLOT_STATES = ["AVAILABLE", "RESERVED", "SOLD", "BLOCKED", "BOOKED"]
SALEABLE_SHARE = 0.55
DEFAULT_RATE_PER_SQFT = 2500.0
DEFAULT_BOOKING_TOTAL = 1000000.0
DEFAULT_DIRECT_TOTAL = 2500000.0

# fixed values: uploads
UPLOAD_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff"]
UPLOAD_MAX_BYTES = 50 * 1024 * 1024

# fixed values: option badges of the three best variants
OPTION_BADGES = [
    "OPTION 1 — BEST OVERALL",
    "OPTION 2 — BEST ACCESS",
    "OPTION 3 — BEST LAND UTILIZATION",
]

# fixed values: city centres (key, latitude, longitude), searched in this order
KNOWN_CITIES = [
    ("pune", 18.5204, 73.8567), ("mumbai", 19.0760, 72.8777), ("thane", 19.2183, 72.9781), ("navi mumbai", 19.0330, 73.0297),
    ("nagpur", 21.1458, 79.0882), ("nashik", 19.9975, 73.7898), ("aurangabad", 19.8762, 75.3433),
    ("chhatrapati sambhajinagar", 19.8762, 75.3433), ("solapur", 17.6599, 75.9064), ("kolhapur", 16.7050, 74.2433),
    ("satara", 17.6805, 74.0183), ("amravati", 20.9374, 77.7796), ("nanded", 19.1383, 77.3210), ("delhi", 28.6139, 77.2090),
    ("bangalore", 12.9716, 77.5946), ("bengaluru", 12.9716, 77.5946), ("hyderabad", 17.3850, 78.4867),
]
