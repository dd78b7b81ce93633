"""Schemas of the inputs; nothing is inferred."""

PINGS = "MMSI long, BaseDateTime timestamp_ntz, LAT double, LON double, SOG double, COG double, Heading double, VesselName string, IMO string, CallSign string, VesselType int, Status int, Length double, Width double, Draft double, Cargo int, TransceiverClass string"
DEPLOYMENTS = "col0 string, col1 string, col2 string, `AIS data file` string, `Audio Start` timestamp_ntz, `Audio End` timestamp_ntz"
ANNOTATIONS = "FileOk boolean, ClassSpecies string, FilePath string, Soundfile string, Dataset string, FileBeginSec double, FileEndSec double"
WINDOWS = "file string, primary_label string, labels string, multilabel boolean, recording string, dataset string, original_filepath string, window_start double, window_end double, window_length double, annotation_start double, annotation_end double, num_annotations int, num_labels int, original_sample_rate int, sample_rate int"
TRACK = "file_name string, MMSI long, timestamp timestamp_ntz, lat double, lon double, az_deg double, el_deg double, range_m double"
FILES = "path string, modificationTime timestamp, length long, content binary"
EMBEDDINGS = "rec string, win_idx int, ts timestamp_ntz, embedding array<float>"
CENTROIDS = "level int, kind string, cid int, cvec array<double>, n long"
EDGES = "level int, child long, parent int"
