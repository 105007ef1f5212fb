"""Declared schemas of text-borne inputs, as Spark DDL."""

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
PAIRS = "ARRAY<ARRAY<DOUBLE>>"

CRM = {
    "plots": (
        "id STRING, projectId STRING, plotNo STRING, area DOUBLE, price DOUBLE, status STRING, customerId STRING, "
        "brokerId STRING, facing STRING, dimensions STRING, isCorner BOOLEAN, notes STRING"
    ),
    "customers": (
        "id STRING, name STRING, email STRING, phone STRING, city STRING, assignedPlots ARRAY<STRING>, "
        "projectId STRING, totalInvested DOUBLE, status STRING, bookingDate STRING"
    ),
    "brokers": (
        "id STRING, name STRING, contactPerson STRING, reraId STRING, phone STRING, commission DOUBLE, totalDeals INT, "
        "totalEarned DOUBLE, pendingPayout DOUBLE, assignedProjects ARRAY<STRING>"
    ),
    "payments": (
        "id STRING, customerId STRING, projectId STRING, plotId STRING, amount DOUBLE, type STRING, method STRING, "
        "status STRING, dueDate STRING, paidDate STRING, receipt STRING"
    ),
    "documents": (
        "id STRING, name STRING, type STRING, category STRING, projectId STRING, customerId STRING, status STRING, "
        "regNumber STRING, tags ARRAY<STRING>, uploadedAt STRING"
    ),
    "monthly": "month STRING, revenue DOUBLE, target DOUBLE, plotsSold INT",
}

PROJECT_PAYLOAD = (
    "id STRING, name STRING, developerName STRING, projectType STRING, status STRING, "
    "location STRUCT<state: STRING, district: STRING, taluka: STRING, city_village: STRING, pincode: STRING, "
    "latitude: DECIMAL(10,8), longitude: DECIMAL(11,8)>, surveyNumbers ARRAY<STRING>, "
    "commercial STRUCT<grossLandArea: DECIMAL(14,4), areaUnit: STRING, minPrice: DECIMAL(14,2), maxPrice: DECIMAL(14,2), "
    "launchDate: STRING, completionDate: STRING>, "
    "legal STRUCT<reraNumber: STRING, approvalAuthority: STRING>, layout STRUCT<fileName: STRING>"
)

LAYOUT_MODEL = (
    "status STRING, metadata STRUCT<layoutVersion: INT, changeSummary: STRING, updatedAt: STRING>, "
    f"boundary STRUCT<boundaryId: STRING, geometry: {PAIRS}, boundingBox: ARRAY<DOUBLE>, area: DOUBLE>, "
    f"roads ARRAY<STRUCT<roadId: STRING, roadName: STRING, geometry: {PAIRS}>>, "
    f"plots ARRAY<STRUCT<id: STRING, plotNumber: STRING, polygon: {PAIRS}, centroid: ARRAY<DOUBLE>, area: DOUBLE, facing: STRING>>, "
    "labels ARRAY<STRUCT<labelId: STRING, rawText: STRING, associatedEntityId: STRING>>, svgContent STRING"
)

MANIFEST = "version STRING, files ARRAY<STRING>, hashes MAP<STRING, STRING>"

BOOKING_EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
