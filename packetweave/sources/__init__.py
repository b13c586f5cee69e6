"""Packet-list readers, capture catalogue and result sinks."""
