"""Lists and tables that have to equal the recording format's own.

Counter categories in display order, the counter-hash dictionary and the call-id dictionary.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Display order of categories, and of counters within each.
COUNTER_CATEGORIES = {
    "GPU Activity": [
        "GT Active Core Count",
        "Raytracing Active GT",
    ],
    "Occupancy": [
        "Total Occupancy",
        "Compute Occupancy",
        "Fragment Occupancy",
        "Vertex Occupancy",
        "Occupancy Manager Target",
        "Total Simdgroups Inflight Per Shader Core",
        "Compute Simdgroups Inflight Per Shader Core",
        "Fragment Simdgroups Inflight Per Shader Core",
        "Vertex Simdgroups Inflight Per Shader Core",
        "Occupancy Management L1 Eviction Rate",
    ],
    "Memory Bandwidth": [
        "AF Bandwidth",
        "AF Read Bandwidth",
        "AF Write Bandwidth",
        "AF Peak Bandwidth",
        "AF Peak Read Bandwidth",
        "AF Peak Write Bandwidth",
        "L2 Bandwidth",
    ],
    "Shader Utilization": [
        "Shader Core Utilization",
        "Shader Core Limiter",
        "ALU Utilization",
        "F16 Utilization",
        "F16 Limiter",
        "F32 Utilization",
        "F32 Limiter",
        "IC Utilization",
        "IC Limiter",
        "SCIB Utilization",
        "SCIB Limiter",
        "Control Flow Utilization",
        "Control Flow Limiter",
        "Instruction Dispatch Utilization",
        "Instruction Dispatch Limiter",
        "Instruction Issue Utilization",
        "Instruction Issue Limiter",
        "Address Generation Utilization",
        "Address Generation Limiter",
    ],
    "Shader Launch": [
        "Compute Shader Launch Utilization",
        "Compute Shader Launch Limiter",
        "Fragment Shader Launch Utilization",
        "Fragment Shader Launch Limiter",
        "Vertex Shader Launch Utilization",
        "Vertex Shader Launch Limiter",
    ],
    "L1 Cache": [
        "L1 Load Bandwidth",
        "L1 Store Bandwidth",
        "L1 Cache Utilization",
        "L1 Cache Limiter",
        "Buffer L1 Load Bandwidth",
        "Buffer L1 Store Bandwidth",
        "Buffer L1 Load Ratio",
        "Buffer L1 Store Ratio",
        "Buffer L1 Miss Rate",
        "Imageblock L1 Load Bandwidth",
        "Imageblock L1 Store Bandwidth",
        "Imageblock L1 Load Ratio",
        "Imageblock L1 Store Ratio",
        "Threadgroup Memory L1 Load Bandwidth",
        "Threadgroup Memory L1 Store Bandwidth",
        "Threadgroup L1 Load Ratio",
        "Threadgroup L1 Store Ratio",
        "Stack L1 Load Bandwidth",
        "Stack L1 Store Bandwidth",
        "Stack L1 Load Ratio",
        "Stack L1 Store Ratio",
        "GPR L1 Load Bandwidth",
        "GPR L1 Store Bandwidth",
        "GPR L1 Read Ratio",
        "GPR L1 Write Ratio",
        "Other L1 Load Bandwidth",
        "Other L1 Store Bandwidth",
        "Other L1 Loads Ratio",
        "Other L1 Stores Ratio",
    ],
    "L1 Residency": [
        "L1 Total Occupancy",
        "L1 Total Bytes Occupancy",
        "L1 Buffer Occupancy",
        "L1 Buffer Bytes Occupancy",
        "L1 Imageblock Occupancy",
        "L1 Imageblock Bytes Occupancy",
        "L1 Threadgroup Occupancy",
        "L1 Threadgroup Bytes Occupancy",
        "L1 GPR Occupancy",
        "L1 GPR Bytes Occupancy",
        "L1 Stack Occupancy",
        "L1 Stack Bytes Occupancy",
        "L1 Other Occupancy",
        "L1 Other Bytes Occupancy",
        "L1 Raytracing Scratch Occupancy",
        "L1 Raytracing Scratch Bytes Occupancy",
    ],
    "L2 / Texture / MMU": [
        "L2 Cache Utilization",
        "L2 Cache Limiter",
        "Texture Cache Utilization",
        "Texture Cache Limiter",
        "Texture Read Utilization",
        "Texture Read Limiter",
        "Texture Write Utilization",
        "Texture Write Limiter",
        "TextureFilteringLimiter",
        "CompressionRatioTextureMemoryRead",
        "MMU Utilization",
        "MMU Limiter",
    ],
    "Raytracing": [
        "Raytracing Active",
        "Ray Occupancy",
        "Leaf Test Occupancy",
        "Ray T Leaf Test",
        "Raytracing Node Test",
        "Intersect Ray Threads",
        "Raytracing Scratch L1 Load Bandwidth",
        "Raytracing Scratch L1 Store Bandwidth",
        "Raytracing Scratch L1 Load Ratio",
        "Raytracing Scratch L1 Store Ratio",
    ],
}
OTHER_CATEGORY = "Other Counters"

# Hash, hardware group, index, label, derived names.
COUNTER_HASHES = [
    ("_bc236dcf3744edf6bcf329ae47088528b35ea5e0beac601cf6781545eb2327cc", "APS_USC", 0, "USC Counter 0", []),
    ("_0f214de435fcac756d84217b6540743235c7b1d500f32f8d0cb68aaaa75ac3e2", "APS_USC", 1, "USC Counter 1", []),
    ("_5fa064796fa00e51a16682635d496690f5bb01777755209762a8752a444bde93", "APS_USC", 2, "USC Counter 2", []),
    ("_f30d812c264ead364d91a31eacd9fc8714703d9da79f2df8a51edc8b4e53bff3", "APS_USC", 3, "USC Counter 3", []),
    ("_fa953797d6623765218f4f921adcc6a5994bbdbeffb8972600a1055083292e8a", "APS_USC", 4, "USC Counter 4", []),
    ("_ae23bde9704f5d8ed4f6fe1bd07d71d94edccfc3853db7d008dce330be2b3844", "APS_USC", 5, "USC Counter 5", []),
    ("_f1f19f9b5367da3da259d84460e29e1286ac04d08bcde9ec343fab5a43ce7386", "APS_USC", 6, "USC Counter 6", []),
    ("_dc9d2c02b3df41ad60f6512a3823b2d0f9b735ae9c41650c4396bac13a7a3c5e", "APS_USC", 7, "USC Counter 7", []),
    ("_3ee42b964ae05a0daaab1ed4621a4811bc2fe4e672fe5e3c84717c5b98184827", "APS_USC", 8, "USC Counter 8", []),
    ("_b08194796a2cb35a8699c8d23b129c582951d9d1941fbc8e36dbaafa02d474e7", "APS_USC", 9, "USC Counter 9", []),
    ("_f539a056fbd45e39d61b9d34af0ea1a305dd8af6f005b5aa29488f2c966e7f21", "BMPR_RDE_0", 0, "MainMemory Read Bytes (VS/FS)", ["FSArithmeticIntensity", "FSBytesReadFromMainMemory", "FSMainMemoryThroughput", "VSArithmeticIntensity", "VSBytesReadFromMainMemory", "VSMainMemoryThroughput"]),
    ("_c420303ee3c2ea941491fa0a071ec1553251898524fce318c3635bc711160395", "BMPR_RDE_0", 1, "MainMemory Read Bytes (VS/FS) [alt]", ["FSArithmeticIntensity", "FSBytesReadFromMainMemory", "FSMainMemoryThroughput", "VSArithmeticIntensity", "VSBytesReadFromMainMemory", "VSMainMemoryThroughput"]),
    ("_c89f25b2a31116ea6540fc6b89b623da7d4cbc9b2349ce7dbe4423a1395da60a", "BMPR_RDE_0", 2, "MainMemory Write Bytes", ["BytesWrittenToMainMemory", "CSArithmeticIntensity", "FSArithmeticIntensity", "FSBytesWrittenToMainMemory", "FSMainMemoryThroughput", "GPUWriteBandwidth", "MainMemoryThroughput", "MainMemoryTraffic", "VSArithmeticIntensity", "VSBytesWrittenToMainMemory", "VSMainMemoryThroughput"]),
    ("_7eba0657c66c2437c8d6952fb82117b9399d920ea84fa32c5bdc9d1dee49e290", "BMPR_RDE_0", 3, "MainMemory Write Bytes [alt]", ["BytesWrittenToMainMemory", "CSArithmeticIntensity", "FSArithmeticIntensity", "FSBytesWrittenToMainMemory", "FSMainMemoryThroughput", "GPUWriteBandwidth", "MainMemoryThroughput", "MainMemoryTraffic", "VSArithmeticIntensity", "VSBytesWrittenToMainMemory", "VSMainMemoryThroughput"]),
    ("_5c5c55d05fb355aa5be61ac63c88eb4a2a521a47dd8f79c18b5c1df163d5cb55", "BMPR_RDE_0", 4, "L2 Cache Utilization", ["L2CacheLimiter", "L2CacheMissRate", "L2CacheUtilization"]),
    ("_c9bcd5df6397dc8477a12ddf9358bccbbb3d8e52fc3dadab320be9bbb14fe157", "BMPR_RDE_0", 5, "L2 Cache Limiter", ["L2CacheLimiter"]),
    ("_fdc48a2370f6885da6ac169661812057de2cf71fbbbcb5df8348a78f112992dc", "BMPR_RDE_0", 6, "MMU Limiter", ["MMULimiter", "MissBufferFullStallRatio"]),
    ("_6d6a7c8efb15986fa71f8bf4a6a06f8942199b36680e516766e92490607c958d", "BMPR_RDE_0", 7, "MMU Utilization", ["MMULimiter", "MMUUtilization", "MainMemoryTraffic"]),
    ("_44b570b50d07ac48e94ccb4a92c113afe3626e472a1ab87b8f5374302c9c5f34", "BMPR_RDE_0", 8, "BMPR Counter 8", []),
    ("_61f7db669b241a51962b25096fa7f4bdb11deb4d851c51ed91c34b4f6b086d75", "BMPR_RDE_0", 9, "GPU Cycles (BMPR)", ["GPUCycles"]),
    ("_53c82a25ac54f8ecd1e94581a4020f0a20529b4813cab97e3977346ad0e270a8", "Firmware", 0, "Firmware Counter 0", []),
    ("_0965349a7930ddeeae0312bca50ac5672d7ecdb1e38a915536c0e7b8a1a3c321", "Firmware", 1, "Firmware Counter 1", []),
    ("_04d4411374e68233627aa77e33b97414d97097b7d3599dc0555f05e8ba0c27ad", "RDE_0", 0, "Texture Memory Read Compression", ["CompressionRatioTextureMemoryRead"]),
    ("_8788387fa2f782d31f4553bc55eb34284415d12b986df376e394838d5075f058", "RDE_0", 1, "MMU TLB Requests", ["MMUTLBRequests"]),
    ("_7c42e99464b33ee51de11bdd9f8cf11a14473f7061e75f7589a3578a7757abfd", "RDE_0", 2, "Texture Filtering Limiter", ["TextureFilteringLimiter"]),
    ("_8ff5f6e1c2e52558354049aef96f7abf429f223a3fc4e626292d894456e02fc2", "RDE_0", 3, "RDE Counter 3", []),
    ("_eb1b52d1bee0dd7bb1d4f6345a6a34e9d9f75340093e425454be8205d717c2ba", "RDE_0", 4, "RDE Counter 4", []),
    ("_ae304fc8bce5708ffef30935687e442d6bea78f814055a5fe6e3380013d7e507", "RDE_0", 5, "Texture Samples", ["CSTextureSamples", "CSTextureSamplesPerInvocation", "FSTextureSamples", "FSTextureSamplesPerInvocation", "PredicatedTextureReadPercentage", "TextureAccesses", "TextureSamples", "UnCompressedSamplesPercent", "UncompressedSamples", "VSTextureSamples", "VSTextureSamplesPerInvocation"]),
    ("_8922765bce9a86586c4e9f2d8c17967bf71fc42fefdc94b60ac069f686424044", "RDE_0", 6, "RDE Counter 6", []),
    ("_d856a24dfeb33f1dad922753efc16618fdf12ef3544115f2f5fffd93affab8d5", "RDE_0", 7, "RDE Counter 7", []),
    ("_7646a8523871192073a29fb3af219f4dbddae3339e969e0da8ef8d84a3d46ec5", "RDE_0", 8, "TPU/Sample Limiter", ["FragmentSampleLimiter", "FragmentTPULimiter", "SampleLimiter", "TPULimiter", "VertexSampleLimiter", "VertexTPULimiter"]),
    ("_fec93bc804b85a65d152fdd4747b95f2b6633ea518b6bb44a7bc87186198c2a8", "RDE_0", 9, "RDE Counter 9", []),
    ("_da0afb5d20fd710a2f7ce18da42b2a53dc3d3fcfe45ac35c28e75d4402986d37", "RDE_0", 10, "RDE Counter 10", []),
    ("_1827ca25b7318e2df60eb0fe4f0c290b43054021ec3233e1fcdcf7b622fe4589", "RDE_0", 11, "Texture Memory Read Compression [alt]", ["CompressionRatioTextureMemoryRead"]),
    ("_28b593c4df5283c263b57e9a6d113d841094eb62c8e83c152a3d733a17af7b80", "RDE_0", 12, "GPU Cycles (RDE)", ["GPUCycles"]),
]

# Call id and API name.
CALL_NAMES = {
    -16383: "endEncoding (blit, GPUTools tracking)",
    -16377: "blit.copy(from:to:)",
    -16376: "endEncoding (blit)",
    -16371: "setPurgeableState: (GPUTools-inserted)",
    -16370: "endEncoding (GPUTools blit encoder)",
    -16367: "setPurgeableState: (user)",
    -16363: "MTLCommandBuffer.commit",
    -16361: "MTLCommandBuffer.waitUntilCompleted",
    -16356: "addCompletedHandler:",
    -16355: "MTLCommandBuffer.computeCommandEncoder",
    -16354: "makeBlitCommandEncoder",
    -16352: "MTLCommandQueue.commandBuffer",
    -16343: "MTLDevice.makeBuffer(length:options:)",
    -16338: "setComputePipelineState:",
    -16337: "setBytes:length:atIndex:",
    -16336: "setBuffer:offset:atIndex:",
    -16327: "dispatchThreadgroups:threadsPerThreadgroup:",
    -16325: "endEncoding (compute)",
    -16316: "makeComputePipelineState(function:)",
    -16314: "makeBuffer(length:) variant",
    -16313: "makeBuffer(bytes:length:options:)",
    -16305: "makeLibrary(source:options:)",
    -16299: "newComputePipelineStateWithFunction:error:",
    -16290: "makeFunction(name:)",
    -16227: "setBytes:length:atIndex: (inline)",
    -16078: "dispatchThreads:threadsPerThreadgroup:",
    -16067: "supportsFamily:",
    -16009: "memoryBarrierWithScope:",
    -16008: "memoryBarrier(resources:)",
    -15996: "makeSharedEvent()",
    -15990: "encodeSignalEvent / event.notify()",
    -15973: "event cleanup",
    -15736: "newLibraryWithURL:",
    -15422: "MTLSharedEvent.notifyListener:atValue:",
    -10228: "internal.bufferDidModify",
    -10223: "internal.bufferContents",
    -10203: "internal.resourceID",
    -10191: "internal.bufferGPUAddress",
    -10186: "internal.bufferCompleted",
}

# Source tables in order of preference.
CPU_SOURCES = ("cpu-profile", "time-profile")
GPU_SOURCES = ("metal-gpu-intervals", "metal-application-intervals", "metal-driver-intervals")

# Drawing colors of edges.
EDGE_COLORS = {"RAW": "#e63946", "WAW": "#f4a261", "WAR": "#457b9d", "SHARED": "#6c757d"}
BARRIER_COLOR = "#e63946"
GROUP_EDGE_COLOR = "#6c757d"

CALL_IDS = tuple(CALL_NAMES)


def _local(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A plan-local relation: Spark knows its size and can fold it, unlike rows shipped through Python."""
    schema = T.StructType.fromDDL(ddl)
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(schema)}
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema)


def counter_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (name, category, rank, idx)
        for rank, (category, names) in enumerate(COUNTER_CATEGORIES.items())
        for idx, name in enumerate(names)
    ]
    return _local(spark, "counter string, category string, cat_rank int, idx int", rows)


def counter_hashes(spark: SparkSession) -> DataFrame:
    return _local(spark, "hash string, hw_group string, idx int, label string, vendor_names array<string>", COUNTER_HASHES)


def call_names(spark: SparkSession) -> DataFrame:
    return _local(spark, "call_id int, call_name string", list(CALL_NAMES.items()))
