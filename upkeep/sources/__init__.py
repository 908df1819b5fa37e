"""Tables: contracts, loaders, the fleet adapter and sinks."""
