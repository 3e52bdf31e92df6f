"""Station list and process rule table."""

# Station codes, in the order in which ties between stations are listed.
STATIONS = ("MM_1", "EC_1", "SM_1", "HBW_1", "OV_1", "VGR_1", "WT_1")

# Fixed values: (station, keywords, activity, process, next station). The first rule of a
# station whose keywords all occur in the task applies, so the order is part of the table.
RULES = (
    ("VGR_1", ("transport", "oven"), "Pickup and transport to Oven", "Production", "OV_1"),
    ("VGR_1", ("transport", "milling"), "Pickup and transport to Milling Machine", "Production", "MM_1"),
    ("VGR_1", ("transport", "sink"), "Pickup and transport to Sink (SM)", "Production", "SM_1"),
    ("VGR_1", ("transport", "dps"), "Deliver workpiece to DPS", "Production", "DPS"),
    ("VGR_1", ("transport", "hbw"), "Transport workpiece to HBW", "Storage", "HBW_1"),
    ("VGR_1", ("transport", "warehouse"), "Transport workpiece to HBW", "Storage", "HBW_1"),
    ("VGR_1", ("transport",), "Transport workpiece (destination TBD)", "Production/Storage", "-"),
    ("VGR_1", ("pick", "dps"), "Get Workpiece from DPS", "Storage", "EC_1"),
    ("VGR_1", ("pick",), "Pick up workpiece", "Production/Storage", "-"),
    ("VGR_1", ("deliver",), "Deliver workpiece to DPS", "Production", "DPS"),
    ("VGR_1", ("move", "dps"), "Move to DPS", "Production", "DPS"),
    ("VGR_1", ("mov", "warehouse"), "Move to HBW holding position", "Storage", "HBW_1"),
    ("VGR_1", ("mov",), "Move to target station", "Production/Storage", "-"),
    ("VGR_1", ("calibrat",), "Calibrate gripper robot components", "Maintenance", "-"),
    ("HBW_1", ("unload",), "Unload workpiece from warehouse slot", "Production", "VGR_1"),
    ("HBW_1", ("stor",), "Store workpiece in warehouse slot", "Storage", "idle"),
    ("HBW_1", ("calibrat",), "Calibrate warehouse components", "Maintenance", "-"),
    ("HBW_1", ("fetch",), "Fetch workpiece from slot", "Production", "VGR_1"),
    ("OV_1", ("heat",), "Heat workpiece in oven", "Production", "MM_1 via VGR_1"),
    ("OV_1", ("burn",), "Heat workpiece in oven", "Production", "MM_1 via VGR_1"),
    ("OV_1", ("transport", "mill"), "Transport workpiece to Milling Machine", "Production", "MM_1"),
    ("OV_1", ("load",), "Load workpiece into oven", "Production", "OV_1"),
    ("OV_1", ("unload",), "Unload workpiece from oven", "Production", "MM_1 via VGR_1"),
    ("MM_1", ("mill",), "Mill workpiece", "Production", "SM_1 via VGR_1"),
    ("MM_1", ("load",), "Load workpiece into milling machine", "Production", "MM_1"),
    ("MM_1", ("unload",), "Unload workpiece from milling machine", "Production", "SM_1 via VGR_1"),
    ("SM_1", ("sort",), "Sort workpiece by color/type", "Production", "DPS via VGR_1"),
    ("SM_1", ("convey",), "Convey workpiece on sorting belt", "Production", "SM_1"),
    ("SM_1", ("separate",), "Separate workpiece", "Production", "DPS via VGR_1"),
    ("EC_1", ("detect", "color"), "Detect workpiece color/type", "Storage", "HBW_1 via VGR_1"),
    ("EC_1", ("detect",), "Sensor detection", "Ambient", "-"),
    ("WT_1", ("convey",), "Convey workpiece on transport belt", "Production", "-"),
    ("WT_1", ("transport",), "Transport workpiece on belt", "Production", "-"),
)

# Next stations that are not a station.
NO_NEXT = ("-", "idle", "")

RULE_SCHEMA = (
    "priority int, station string, keywords array<string>, activity string, process string, "
    "next_station string"
)


def rule_rows() -> list[tuple]:
    return [(i, s, list(k), a, p, n) for i, (s, k, a, p, n) in enumerate(RULES, start=1)]
