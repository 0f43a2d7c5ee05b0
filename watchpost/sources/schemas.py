"""Declared schemas of the surveillance tables and files."""
from __future__ import annotations

POINT = "struct<x:double,y:double>"
DETECTIONS = ("camera_id string, frame long, ts timestamp, det_id string, object_class string, confidence double, "
              "x1 double, y1 double, x2 double, y2 double")
TRACK_POINTS = ("camera_id string, track_id long, event_id long, ts timestamp, ts_us long, object_class string, "
                "confidence double, x double, y double, hits long, lost_frames long")
ZONES = ("zone_id string, camera_id string, zone_name string, kind string, "
         f"points array<{POINT}>, zone_deg double, tolerance double, enabled boolean, is_lawful_route boolean")
CAMERAS = ("camera_id string, name string, node_id string, profile string, role string, sensor_type string, "
           "stream_url string, claimed_width int, claimed_height int, claimed_fps double, enabled boolean")
EVENT = ("struct<event_id:long,camera_id:string,event_type:string,object_class:string,track_id:long,zone_id:string,"
         "score:double,rank:int,ts_us:long,ledger_index:long,prev_hash:string,entry_hash:string>")
BATCH = f"node_id string, sent_us long, received_us long, clock_trusted boolean, events array<{EVENT}>"
FRAME_METRICS = ("camera_id string, frame_id long, ts_us long, frame_w int, frame_h int, luma double, sharpness double, "
                 "eff_res double, blockiness double, noise double, mean double, std double, focus double, motion double, digest string")
